"""Token counts by the whole-token shortcut.

Offline, every string of the vocabulary is given to the tokenizer on its own; those that come back as just their own id
are proven whole tokens. A pre-token among them counts as one without any merging; only the rest is merged.
"""

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from plantwatch.llm.pieces import PieceCache, groups, has_safe_cuts, load

LIMIT = 1024


def whole_tokens(path):
    """The vocabulary's strings, as the pre-tokenizer spells them, that encode alone as one token: the offline proof."""
    tokenizer = load(path)
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    strings = tokenizer.decode_batch([[i] for i in vocabulary.values()], skip_special_tokens=False)
    encoded = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    return frozenset(spelled for (spelled, i), e in zip(vocabulary.items(), encoded) if e.ids == [i])


@lru_cache(maxsize=4)
def _counter(path, proven):
    """A cache that finds how many tokens each piece has."""
    tokenizer = load(path)
    split, merge = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def count(piece):
        if any(s in piece for s in special):
            return len(tokenizer.encode(piece, add_special_tokens=False).ids)
        return sum(1 if pre in proven else len(merge(pre)) for pre, _ in split(piece))

    return PieceCache(lambda new: map(count, new))


@lru_cache(maxsize=4)
def _sentencepiece(path):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def _plain(path):
    return load(path)


def _counts(texts, path, proven):
    """Token counts of a list of texts."""
    result = []
    for group in groups(texts, len, 1 << 20):
        if proven is not None:
            cache = _counter(path, proven)
            cut = cache.of(group)
            result += [sum(map(cache.__getitem__, c)) for c in cut]
        elif path.endswith(".model"):
            result += [len(ids) for ids in _sentencepiece(path).encode(group, num_threads=1)]
        else:
            result += [len(e.ids) for e in _plain(path).encode_batch_fast(group, add_special_tokens=False)]
    return result


def token_counts(docs, path, limit=LIMIT, id_column="doc_id", text_column="text"):
    """Per row: the id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``path`` is a vocabulary file that every machine has: .json for the tokenizers library, .model for sentencepiece.
    Byte-level BPE files take the shortcut; layouts for which it is not proven are encoded plainly. Counts are those of
    the library without begin, end or other added special tokens; a special string inside a text is one token, as the
    library has it.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows come back repeated, a null id stays null, other
    columns of the input are left out whatever their names, an empty table gives an empty result. Very long
    texts are counted whole, one text at a time.
    """
    proven = None
    if path.endswith(".json") and has_safe_cuts(path):
        proven = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(_counts(texts.tolist(), path, proven and proven.value), dtype="int64")

    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column), F.octet_length(text).cast("bigint").alias("n_bytes"), count(text).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
