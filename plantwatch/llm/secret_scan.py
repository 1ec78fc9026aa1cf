"""Secrets in texts: fixed patterns, and literals that reach sensitive names.

The scan lexes source and configuration syntax into assignments, a name and an expression of literals and names joined by
``+``; a type annotation between name and ``=`` is passed over, and ``+=`` adds to what the name holds. It runs them in text
order, keeps what each name holds (so constants propagate through other names, joins and ``${name}`` inside strings) and
scores a literal by the most sensitive name that it reaches and by its own looks. A value is kept as references to the
values and literals that it was joined from, with the counts of its characters, so its length and its parts have no limit.
"""

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from heapq import merge
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F

# The base patterns, their least lengths, and their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "literal")

#: What a word of a name says about its value.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "pwd": 0.9, "secret": 1.0, "secrets": 0.9, "token": 0.8,
             "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "key": 0.45, "api": 0.4, "auth": 0.5, "authorization": 0.7, "bearer": 0.8,
             "private": 0.5, "access": 0.3, "signing": 0.4, "signature": 0.4, "encryption": 0.4, "master": 0.3, "client": 0.2, "cookie": 0.5,
             "session": 0.4, "webhook": 0.4, "salt": 0.6, "pin": 0.4}
HARMLESS = {"public": 0.7, "name": 0.6, "id": 0.3, "count": 0.9, "length": 0.9, "size": 0.9, "path": 0.6, "file": 0.5, "url": 0.4, "type": 0.7,
            "expiry": 0.9, "expires": 0.9, "ttl": 0.9, "max": 0.9, "min": 0.9, "limit": 0.9, "label": 0.6, "hint": 0.8, "field": 0.7, "prompt": 0.8}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|0+|1234\d*|change_?me|example.*|your[-_ ].*|test.*|dummy.*|none|null|true|false|required|todo|<.*>|\{.*\}|%.*%)$")
THRESHOLD = 0.6

_LITERAL = r"""(?:[rbuf]{0,2}"(?:[^"\\\n]|\\.)*"|[rbuf]{0,2}'(?:[^'\\\n]|\\.)*')"""
_NAME = r"[A-Za-z_][A-Za-z0-9_]*+(?:[.-][A-Za-z_][A-Za-z0-9_]*+)*+"
# a name begins where no name goes on, and is read in one go: every letter is looked at a bounded number of times
_BEGIN = r"(?<![A-Za-z0-9_])(?<![A-Za-z0-9_][.-])"
_BARE = r"[A-Za-z0-9/_.~$-][A-Za-z0-9+/_.=~$-]*"
_TERM = rf"(?:{_LITERAL}|{_BARE})"


def _type(letter, inside):
    """A type of an annotation: names of such letters, with arguments in brackets, joined by ``|``."""
    part = rf"""(?:&[ \t]*+)?(?:'static[ \t]++)?(?:(?:mut|const|readonly)[ \t]++)?\**+[A-Za-z_]{letter}*+(?:(?:\.|::)[A-Za-z_]{letter}*+)*+(?:[\[<](?:{inside}|::)*[\]>])?[?!]?"""
    return rf"{part}(?:[ \t]*+\|[ \t]*+{part})*+"


_TYPE, _PLAIN_TYPE = _type(r"\w", r"""[^\n"'={}():]"""), _type("[A-Za-z_]", r"""[^\n\d"'={}():]""")
# before a bare value only a type without digits, set off by white space: ``token: abc=def`` holds abc=def
_ANNOTATION = rf"""[?!]?[ \t]*+:[ \t]*+(?:{_TYPE}[ \t]*+(?==[ \t]*+[rbuf]{{0,2}}["'])|{_PLAIN_TYPE}[ \t]++(?==(?![=>])))"""
_STATEMENT = re.compile(rf"""{_BEGIN}(?P<name>{_NAME})(?:\[["']?(?P<item>{_NAME})["']?\])?["']?(?:{_ANNOTATION})?[ \t]*(?P<sign>\+=|:=|=>|=(?!=)|:(?![:/]))[ \t]*(?P<value>{_TERM}(?:[ \t]*\+[ \t]*{_TERM})*)""")
# configuration in attributes: the name in one, the literal in the next
_ATTRIBUTES = re.compile(rf"""\b(?:key|name)=(["'])(?P<name>{_NAME})\1[ \t]++value=(?P<value>{_LITERAL})""")
_TERMS = re.compile(rf"(?P<quoted>{_LITERAL})|(?P<bare>{_BARE})")
_INSIDE = re.compile(rf"\$\{{({_NAME})\}}|\$([A-Za-z_][A-Za-z0-9_]*)")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def sensitivity(name):
    """0 to 1: how likely what the name holds is a secret."""
    words = [w.lower() for w in _WORDS.findall(name)]
    return max(0.0, min(1.0, sum(SENSITIVE.get(w, 0.0) - HARMLESS.get(w, 0.0) for w in words)))


class _Value:
    """What a name holds: the values and spans of literals that it was joined from, and what ``looks`` asks of the whole."""

    HEAD = 64

    def __init__(self):
        self.parts, self.spans, self.score = [], [], 0.0
        self.head, self.last, self.length, self.counts = "", "", 0.0, {}

    def _extend(self, head, last, length, counts):
        if length:
            self.head, self.last, self.length = (self.head + head)[:self.HEAD], last, self.length + length
            for c, n in counts.items():
                self.counts[c] = self.counts.get(c, 0.0) + n
            if self.length > 2.0**900:  # only shares matter at this size
                self.length, self.counts = self.length * 2.0**-800, {c: n * 2.0**-800 for c, n in self.counts.items()}

    def add_text(self, text):
        self._extend(text[:self.HEAD], text[-1:], len(text), Counter(text))

    def add(self, part):
        self.parts.append(part)
        self._extend(part.head, part.last, part.length, part.counts)

    def looks(self):
        if self.length < 6 or any(c.isspace() for c in self.counts):
            return 0.0
        # a longer value matches a placeholder exactly if its head, one of each of its characters and its last do
        if PLACEHOLDER.match(self.head if self.length <= self.HEAD else self.head + "".join(self.counts) + self.last):
            return 0.0
        kinds = sum(any(test(c) for c in self.counts) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
        shares = [n / self.length for n in self.counts.values() if n / self.length > 0]
        return min(1.0, -sum(p * math.log2(p) for p in shares) / 3.5) * (1.0 if kinds > 1 else 0.5)


def looks(value):
    """0 to 1: how much a value looks like one that was made, by its length, kinds of characters and entropy."""
    held = _Value()
    held.add_text(value)
    return held.looks()


def assignments(text):
    """(name, whether it adds to the name, terms) in text order; a term is (kind, value, start, end), kind literal or bare."""
    if "=" not in text and ":" not in text:
        return
    found = _STATEMENT.finditer(text)
    if "value=" in text:
        found = merge(found, _ATTRIBUTES.finditer(text), key=lambda m: m.start())
    for m in found:
        terms, base = [], m.start("value")
        parts = m.groupdict()
        for t in _TERMS.finditer(m["value"]):
            start, end = base + t.start(), base + t.end()
            if t["quoted"]:
                quote = min(t[0].find(q) for q in "\"'" if q in t[0])
                terms.append(("literal", t[0][quote + 1:-1], start + quote + 1, end - 1))
            else:
                terms.append(("bare", t[0], start, end))
        yield parts.get("item") or m["name"], parts.get("sign") == "+=", terms


def literals(text, threshold=THRESHOLD):
    """Spans of the literals that reach a sensitive name, with their score."""
    held, values, scores = {}, [], {}
    for name, adds, terms in assignments(text):
        value, short = _Value(), name.rpartition(".")[2]
        if adds and (known := held.get(name) or held.get(short)):
            value.add(known)
        for kind, term, start, end in terms:
            if kind == "bare" and (known := held.get(term) or held.get(term.rpartition(".")[2])):
                value.add(known)
                continue
            for ref in _INSIDE.finditer(term):
                if known := held.get(ref[1] or ref[2]):
                    value.add(known)
            plain = _INSIDE.sub("", term)
            if plain:
                value.add_text(plain)
                value.spans.append((start, end))
        held[name] = held[short] = value
        values.append(value)
        score = sensitivity(name)
        value.score = score * value.looks() if score else 0.0
    # parts come before the values that they are in, so from the last on every score reaches all parts
    for value in reversed(values):
        if value.score >= threshold:
            for part in value.parts:
                part.score = max(part.score, value.score)
            for span in value.spans:
                scores[span] = max(value.score, scores.get(span, 0.0))
    return scores


def scan(text, threshold=THRESHOLD):
    """All spans as (kind, start, end), by start and then kind; code points, end exclusive."""
    base = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    base += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    base.sort(key=lambda x: x[1])
    starts, reach = [b for _, b, _ in base], list(accumulate((f for _, _, f in base), max))
    # a literal lies inside a base span if one that begins before it reaches its end
    more = [("literal", s, e) for s, e in literals(text, threshold) if not (k := bisect_right(starts, s)) or reach[k - 1] < e]
    return sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def secrets(docs, threshold=THRESHOLD, id_column="doc_id", text_column="text"):
    """Per row: ``doc_id``, the base counts ``n_assign``, ``n_access`` and ``n_hex``, ``n_literal``, ``base_sha256`` and ``spans``.

    ``spans`` has ``kind:start:end`` of every span, comma-joined, by start and then kind; ``base_sha256`` hashes the same
    text of the base kinds alone. A literal inside a base span isn't listed again. Null and empty texts have no spans.
    Values with white space (passphrases of several words) aren't taken for secrets. Very long texts are scanned whole, in time
    linear in their length; one text is held at a time.
    Repeated rows come back repeated, a null id stays null, other columns are left out, whatever their names; an empty table gives an
    empty result.
    """

    @F.pandas_udf("n_assign bigint, n_access bigint, n_hex bigint, n_literal bigint, base_sha256 string, spans string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                spans = scan(text, threshold)
                n, base = Counter(k for k, _, _ in spans), _joined([s for s in spans if s[0] != "literal"])
                rows.append((*[n[k] for k in KINDS], hashlib.sha256(base.encode()).hexdigest(), _joined(spans)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans"])

    rows = docs.select(F.col(id_column).alias("doc_id"), found(F.coalesce(F.col(text_column), F.lit(""))).alias("f"))
    return rows.select("doc_id", "f.*")
