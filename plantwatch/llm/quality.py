"""Quality score: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Training reads a bounded sample of the labelled rows (``sample``, chosen by a seeded hash of the id; documented bound),
in a seeded order, one row at a time. Scoring is a sparse dot product of a text's n-grams with the weights, on all rows.
"""

import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plantwatch.llm.pieces import groups
from plantwatch.llm.shingles import mix
from plantwatch.llm.store import column_by_parts, kept_rows

#: Words and runs of marks; white space only separates.
TOKEN = re.compile(r"\w+|[^\w\s]+")
BITS = 18
SAMPLE = 4_000
THRESHOLD = 0.3
FOLDS = 5
SCALE = 20.0
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def outline(token):
    """The shape of a token: what stays the same when words are new."""
    if not token[0].isalnum() and token[0] != "_":
        return token[:3]
    kind = "A" if token.isupper() and len(token) > 1 else "0" if token.isdigit() else "Aa" if token[0].isupper() else "a"
    return f"{kind}{min(len(token), 20) // 4}"


class _Hashes(dict):
    """Hashes of the token and of its outline, for the tokens seen; it starts afresh when it grows too large."""

    def __missing__(self, token):
        if len(self) > 100_000:
            self.clear()
        self[token] = value = zlib.crc32(token.encode("utf-8", "replace")) << 32 | zlib.crc32(b"\x01" + outline(token).encode("utf-8", "replace"))
        return value


@lru_cache(maxsize=1)
def _hashes():
    return _Hashes()


def grams(texts, bits=BITS):
    """Hashed n-grams of many texts: a matrix of places, a row for each kind and a column for each token, and the number of
    tokens of each text. Kinds: the token, its outline, the pair with the next token, the pair of outlines, and whether
    the next token is the same. Place 0 stands for no n-gram (the last token of a text has no pair).
    """
    cut = [TOKEN.findall(t) for t in texts]
    counts = np.fromiter(map(len, cut), np.int64, len(cut))
    both = np.fromiter(map(_hashes().__getitem__, chain.from_iterable(cut)), np.uint64, int(counts.sum()))
    token, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    after, shape_after = np.roll(token, -1), np.roll(shape, -1)
    kinds = [token, shape, token * _PAIR + after, shape * _PAIR + shape_after, (token == after).astype(np.uint64)]
    places = np.stack([mix(k + np.uint64(i)) >> np.uint64(64 - bits) for i, k in enumerate(kinds)]).astype(np.int64)
    places = np.maximum(places, 1)
    places[2:, np.cumsum(counts)[counts > 0] - 1] = 0
    return places, counts


def margins(weights, texts, bits=BITS):
    """Sparse dot products: the mean weight of a text's n-grams times ``SCALE``, plus the constant's weight (place 0)."""
    places, counts = grams(texts, bits)
    constant = float(weights[0])
    flat = np.where(places == 0, 0.0, weights[places]).sum(axis=0)
    result = np.full(len(texts), constant)
    full = counts > 0
    if full.any():
        starts = (np.cumsum(counts) - counts)[full]
        result[full] += SCALE * np.add.reduceat(flat, starts) / counts[full]
    return result


def features(text, bits=BITS):
    """Places and values of one text: counts of its n-grams as a share of its tokens, times ``SCALE``, and the constant."""
    places, counts = grams([text], bits)
    found, n = np.unique(places[places > 0], return_counts=True)
    values = np.append(SCALE * n / max(1, counts[0]), 1.0)
    return np.append(found, 0).astype(np.int32), values.astype(np.float32)


def probability(margin):
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -35.0, 35.0)))


def train(rows, bits=BITS, alpha=0.5, beta=1.0, l1=0.02, l2=0.5, epochs=3, seed=7):
    """Weights from (text, label) pairs by follow-the-regularised-leader with a rate for each place.

    The state is two sums a place: of gradients corrected for past moves, and of squared gradients. A place whose sum stays
    within ``l1`` has weight zero. Without rows of both labels all weights but the constant are zero.
    """
    z, n, w = np.zeros(1 << bits), np.zeros(1 << bits), np.zeros(1 << bits)
    seen = [(features(text or "", bits), float(label)) for text, label in rows]
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(seen)):
            (places, values), label = seen[k]
            zs, ns = z[places], n[places]
            now = np.where(np.abs(zs) <= l1, 0.0, (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(ns)) / alpha + l2))
            gradient = (probability(now @ values) - label) * values
            step = (np.sqrt(ns + gradient**2) - np.sqrt(ns)) / alpha
            z[places] += gradient - step * now
            n[places] += gradient**2
    at = np.flatnonzero(n)
    w[at] = np.where(np.abs(z[at]) <= l1, 0.0, (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))
    return w.astype(np.float32)


def held_out(id_column="doc_id"):
    """Whether a row is kept from learning: crc32 of its id as text, modulo 5, is 0. A null id is never learnt from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def fit(docs, labels, sample=SAMPLE, bits=BITS, id_column="doc_id", text_column="text", label_column="quality", seed=7, **settings):
    """Weights learnt from at most ``sample`` labelled rows that are not held out; labels are 0 or 1, others are left out."""
    marked = labels.filter(~held_out(id_column) & F.col(label_column).isin(0, 1)).groupBy(id_column).agg(F.max(label_column).alias("label"))
    chosen = marked.orderBy(F.xxhash64(F.lit(seed), id_column), id_column).limit(sample)
    texts = docs.select(id_column, F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = texts.join(chosen, id_column).groupBy(id_column).agg(F.max("text").alias("text"), F.max("label").alias("label"))
    rows = rows.toPandas().sort_values(id_column)
    return train(zip(rows["text"], rows["label"]), bits, seed=seed, **settings)


def _scorer(spark, weights, bits):
    """A function from lists of texts to lists of probabilities, for tasks."""
    shared = spark.sparkContext.broadcast(weights)

    def scores(texts):
        found = [margins(shared.value, group, bits) for group in groups(texts, len, 1 << 20)]
        return probability(np.concatenate(found)).tolist() if found else []

    return scores


def quality_scores(docs, labels, threshold=THRESHOLD, bits=BITS, id_column="doc_id", text_column="text", **settings):
    """Per row: the id, ``held_out``, ``score`` and ``predicted`` (1 from ``threshold`` on).

    Only the text enters a score. Null and empty texts get the constant's probability; repeated rows come back repeated
    with equal scores; a null id counts as held out; other columns are left out, whatever their names; an empty table
    gives an empty result; without labels every score is one half. Very long texts are scored
    whole, by all their words.
    """
    weights = fit(docs, labels, bits=bits, id_column=id_column, text_column=text_column, **settings)
    scores = _scorer(docs.sparkSession, weights, bits)

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column_by_parts(batch, "text", scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(score, "doc_id bigint, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs, labels, threshold=THRESHOLD, bits=BITS, text_column="text", **settings):
    """The rows whose score reaches ``threshold``, with their own columns."""
    weights = fit(docs, labels, bits=bits, text_column=text_column, **settings)
    scores = _scorer(docs.sparkSession, weights, bits)
    return kept_rows(docs, text_column, lambda texts: [p >= threshold for p in scores(texts)])
