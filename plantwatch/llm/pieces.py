"""Text cut where no token can cross, so that what was tokenised once need not be tokenised again.

In a byte-level BPE whose pre-tokenizer is the usual one of letters, numbers, other marks and white space, a pre-token
never runs from a non-space into a space or a line feed that follows. Such places are safe cuts.
"""

import json
import os
import re

import numpy as np

SAFE_CUT = re.compile(r"(?<=\S)(?=[ \n])")
UNSAFE = re.compile(r"\s[ \n]|\0")


def pieces(text):
    """The text in pieces, in order; joined they give the text again."""
    if UNSAFE.search(text):
        return SAFE_CUT.split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


def load(path):
    """The tokenizer of a .json file, one thread, no truncation, no padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def has_safe_cuts(path):
    """Whether the file is a byte-level BPE without normalizer and without added prefix space."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    added = [t for t in spec.get("added_tokens", []) if t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s|[A-Za-z][.,;:!?]", t["content"])]
    return (spec["model"]["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not added)


def _ends_in_mark(piece):
    """Whether a letter and one mark end the piece: the two are always in different pre-tokens."""
    return piece[-1:] in ".,;:!?" and piece[-2:-1].isalpha() and piece[-2] < "\u0250"


class PieceCache(dict):
    """Values of pieces, found in batches; at most ``most`` are remembered, then it starts afresh.

    Values can be added: that of a piece which ends in a mark is the sum of the values of its two parts.
    """

    def __init__(self, find, most=1_500_000):
        super().__init__()
        self.find, self.most = find, most

    def of(self, texts):
        """For each text the list of its pieces, all of whose values are now in the cache."""
        cut = [pieces(t) for t in texts]
        new = set().union(*cut).difference(self)
        if new and len(self) + len(new) > self.most:
            self.clear()
            new = set().union(*cut)
        marked = [p for p in new if _ends_in_mark(p)]
        plain = new.difference(marked)
        plain.update({p[:-1] for p in marked}.union(p[-1] for p in marked).difference(self))
        plain = list(plain)
        self.update(zip(plain, self.find(plain)))
        self.update((p, self[p[:-1]] + self[p[-1]]) for p in marked)
        return cut


_SPACE, _MARK, _LETTER = 1, 2, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, 10]], _CLASS[list(b".,;:!?")] = _SPACE, _MARK
_CLASS[list(range(65, 91)) + list(range(97, 123))] = _LETTER


def _powers(base, n):
    return np.cumprod(np.full(n, base, np.uint64))


class PieceIds:
    """Token ids of whole texts, by arrays: pieces are cut and hashed in the bytes, and each is tokenised once.

    Besides the safe cuts, a letter and a mark after it are parted: they are never in one pre-token. Pieces are known by
    two 64-bit hashes and their length; at most ``most`` are remembered (about 50 bytes each), then it starts afresh.
    """

    def __init__(self, tokenizer, most=1_000_000):
        self.tokenizer, self.most = tokenizer, most
        self.powers = [_powers(b, 64) for b in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
        self._forget()

    def _forget(self):
        self.key, self.known = np.empty(0, np.uint64), np.empty(0, [("check", "u8"), ("start", "i4"), ("count", "i4")])
        self.pool, self.used = np.empty(1 << 16, "<u4"), 0

    def _add(self, key, check, new):
        """Tokenize new pieces; ``key`` is in ascending order."""
        count, parts = np.empty(len(new), np.int32), []
        for k in range(0, len(new), 8192):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(new[k:k + 8192], add_special_tokens=False)]
            count[k:k + len(ids)] = [len(x) for x in ids]
            parts.append(np.fromiter((i for x in ids for i in x), "<u4"))
        total = int(count.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(len(self.pool) // 2, "<u4")])
        self.pool[self.used:self.used + total] = np.concatenate(parts)
        start = self.used + np.cumsum(count, dtype=np.int64) - count
        self.used += total
        known = np.empty(len(new), self.known.dtype)
        known["check"], known["start"], known["count"] = check, start, count
        at = np.searchsorted(self.key, key)
        self.key, self.known = np.insert(self.key, at, key), np.insert(self.known, at, known)

    def _find(self, key, check):
        """Places in the table; -1 where a piece is not known."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (self.known["check"][at] == check), at, -1)

    def _hashes(self, data, starts, lengths):
        longest = int(lengths.max())
        if longest > len(self.powers[0]):
            self.powers = [_powers(int(p[0]), longest) for p in self.powers]
        place = np.arange(len(data)) - np.repeat(starts, lengths)
        values = data.astype(np.uint64) + np.uint64(1)
        return [np.add.reduceat(values * p[place], starts) + lengths.astype(np.uint64) for p in self.powers]

    def _safe(self, texts):
        """Ids of all texts in one array, and how many each has; the texts have none of ``UNSAFE``."""
        coded = [t.encode() for t in texts]
        raw = b"".join(coded)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        if not raw:
            return np.empty(0, "<u4"), np.zeros(len(texts), np.int64)
        data = np.frombuffer(raw, np.uint8)
        kind = _CLASS[data]
        cut = kind == _SPACE
        cut[1:] |= (kind[1:] == _MARK) & (kind[:-1] == _LETTER)
        text_starts = np.cumsum(sizes) - sizes
        cut[text_starts[sizes > 0]] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.append(starts, len(data)))
        key, check = self._hashes(data, starts, lengths)
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        if (check[first][back] != check).any():  # two pieces of one key: by the library
            return None
        at = self._find(key[first], check[first])
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.key) + len(new) > self.most:
                self._forget()
                new = np.arange(len(first))
            ends = (starts + lengths)[first[new]]
            self._add(key[first[new]], check[first[new]], [raw[s:e].decode() for s, e in zip(starts[first[new]].tolist(), ends.tolist())])
            at = self._find(key[first], check[first])
            if (at < 0).any():
                return None
        known = self.known[at][back]
        count = known["count"].astype(np.int64)
        ends = np.cumsum(count)
        ids = self.pool[np.repeat(known["start"] - (ends - count), count) + np.arange(int(ends[-1]))]
        pieces_before = np.searchsorted(starts, np.append(text_starts, len(data)))
        return ids, np.diff(np.append(0, ends)[pieces_before])

    def of(self, texts):
        """For each text its ids, little-endian unsigned 32-bit integers, as bytes."""
        plain = [k for k, t in enumerate(texts) if not UNSAFE.search(t)]
        result = [None] * len(texts)
        if plain and (found := self._safe([texts[k] for k in plain])) is not None:
            ids, counts = found
            raw, ends = ids.tobytes(), (np.cumsum(counts) * 4).tolist()
            for k, start, end in zip(plain, [0, *ends], ends):
                result[k] = raw[start:end]
        rest = [k for k, r in enumerate(result) if r is None]
        for k, ids in zip(rest, id_bytes(self.tokenizer, [texts[k] for k in rest])):
            result[k] = ids
        return result


def groups(values, weight, most):
    """Lists of neighbours that together weigh at most ``most``, or one value that weighs more."""
    held, load = [], 0
    for value in values:
        w = weight(value)
        if held and load + w > most:
            yield held
            held, load = [], 0
        held.append(value)
        load += w
    if held:
        yield held


def id_bytes(tokenizer, new):
    """Ids of each string as little-endian unsigned 32-bit integers."""
    return [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)]
