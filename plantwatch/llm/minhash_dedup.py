"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the multiset of its five-word shingles; the weight of a shingle is its count in the text times its inverse
document frequency. Consistent weighted sampling draws ``BANDS * ROWS`` samples so that two texts draw the same sample
with the probability of their weighted Jaccard similarity; texts that agree in all samples of a band are candidates, and
candidates are verified by their exact weighted Jaccard similarity.

Document frequency counts unlike documents, not copies: documents are told apart by their least shingle hash, and the
effective number of these (the square of the sum over the sum of squares) is the frequency. A shingle that thousands of
near copies share is thus as rare as their one original, and a licence line in thousands of unlike pages is common.
"""

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from plantwatch.llm.components import components
from plantwatch.llm.pieces import groups
from plantwatch.llm.shingles import WIDTH, mix, shingles, weighed
from plantwatch.llm.store import release, rows_of, written

BANDS, ROWS = 20, 5
THRESHOLD = 0.8
#: Shingles in at most so many unlike documents have the full weight.
RARE = 8
#: Rows of the table of random numbers; a shingle takes the row of its last bits.
TABLE = 1 << 14
#: The common shingles are broadcast up to so many (16 bytes each); beyond that they are joined to the documents.
MOST_BROADCAST = 2_000_000
#: Texts of a cluster that are compared in one task; larger clusters are compared with centres first, and what these leave
#: apart block by block.
BLOCK = 800
#: Share of equal samples from which a pair is verified. A pair of similarity 0.8 has less with a chance of 0.0004.
SAMPLES_ALIKE = 0.66
SEED = 20


# ---- document frequency ---------------------------------------------------------------------------------------------

def _family_keys(values):
    """For one text: the upper 48 bits of each distinct shingle hash, with 16 bits that tell unlike texts apart."""
    if not len(values):
        return values
    family = mix(values.min(keepdims=True))[0] >> np.uint64(48)
    return np.unique(values & ~np.uint64(0xFFFF)) | family


def _document_frequencies(texts, n_buckets, width, rare):
    """(shingle, frequency) of the shingles that more than ``rare`` unlike documents have; shingle is its upper 48 bits."""
    bounds = (np.arange(1, n_buckets, dtype=np.float64) / n_buckets * 2.0**64).astype(np.uint64)
    arrow = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def rows(held):
        keys, counts = weighed(np.concatenate(held)) if held else (np.empty(0, np.uint64), [])
        cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
        found = [(b, keys[i:j].tobytes(), counts[i:j].astype("<u4").tobytes()) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
        return pa.RecordBatch.from_pandas(pd.DataFrame(found, columns=["bucket", "keys", "counts"]), schema=arrow, preserve_index=False)

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for group in groups((t for t, in rows_of(batch)), len, 1 << 20):
                held += [_family_keys(s) for s in shingles(group, width)]
                size += sum(map(len, group))
                if size >= 6 << 20:
                    yield rows(held)
                    held, size = [], 0
        yield rows(held)
        del held
        release()

    def merge(frame):
        keys = np.frombuffer(b"".join(frame["keys"]), "<u8")
        counts = np.frombuffer(b"".join(frame["counts"]), "<u4")
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.float64)
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, counts = keys[starts], np.add.reduceat(counts, starts)
        shingle = keys >> np.uint64(16)
        starts = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
        unlike = np.add.reduceat(counts, starts) ** 2 / np.add.reduceat(counts**2, starts)
        common = unlike > rare
        return pd.DataFrame({"shingle": shingle[starts][common].astype(np.int64), "frequency": unlike[common]})

    found = texts.select("text").mapInArrow(count, "bucket int, keys binary, counts binary")
    return found.groupBy("bucket").applyInPandas(merge, "shingle bigint, frequency double")


def inverse_frequency(frequency, total, rare=RARE):
    """1 for shingles in at most ``rare`` unlike documents, then falling with the logarithm of the frequency."""
    top = np.log1p(max(1.0, total / rare))
    return np.minimum(1.0, np.log1p(np.maximum(total / frequency, 1e-9)) / top)


class _Weights:
    """Weights of the common shingles; all others weigh 1."""

    def __init__(self, shingle, weight):
        order = np.argsort(shingle)
        self.shingle, self.weight = np.asarray(shingle)[order].astype(np.uint64), np.asarray(weight)[order]

    def of(self, values, counts):
        weights = counts.astype(np.float64)
        if len(self.shingle):
            upper = values >> np.uint64(16)
            at = np.minimum(np.searchsorted(self.shingle, upper), len(self.shingle) - 1)
            weights = np.where(self.shingle[at] == upper, weights * self.weight[at], weights)
        return weights


# ---- consistent weighted sampling -----------------------------------------------------------------------------------

@lru_cache(maxsize=1)
def _randoms(samples, seed):
    """r and c (gamma 2, 1) and beta (uniform) for each row of the table and sample, and the value for weight 1."""
    draw = np.random.Generator(np.random.Philox(seed))
    r = draw.standard_gamma(2.0, (TABLE, samples), dtype=np.float32)
    c = draw.standard_gamma(2.0, (TABLE, samples), dtype=np.float32)
    beta = draw.random((TABLE, samples), dtype=np.float32)
    return r, c, beta, (np.log(c) + r * beta - r).astype(np.float32)


def sample(values, weights, samples=BANDS * ROWS, seed=SEED):
    """For each sample the shingle that it draws and the level of its weight.

    With r, c, beta of a shingle: t = floor(ln w / r + beta), ln y = r (t - beta), and the shingle with the least
    ln a = ln c - ln y - r is drawn together with its t; for weight 1, t is 0.
    """
    r, c, beta, unit = _randoms(samples, seed)
    best = np.full(samples, np.inf, np.float32)
    drawn, level, every = np.zeros(samples, np.uint64), np.zeros(samples, np.int64), np.arange(samples)
    for start in range(0, len(values), 4096):
        v, w = values[start:start + 4096], weights[start:start + 4096]
        rows = (v & np.uint64(TABLE - 1)).astype(np.int64)
        a = unit[rows]
        other = np.flatnonzero(w != 1.0)
        t = np.floor(np.log(w[other])[:, None] / r[rows[other]] + beta[rows[other]]) if len(other) else None
        if t is not None:
            a[other] = np.log(c[rows[other]]) - r[rows[other]] * (t - beta[rows[other]]) - r[rows[other]]
        at = a.argmin(axis=0)
        least = a[at, every]
        levels = np.zeros(samples, np.int64)
        if t is not None:
            place = np.full(len(v), -1)
            place[other] = np.arange(len(other))
            hit = place[at] >= 0
            levels[hit] = t[place[at[hit]], every[hit]].astype(np.int64)
        better = least < best
        best[better], drawn[better], level[better] = least[better], v[at[better]], levels[better]
    return drawn, level


def band_keys(drawn, level, bands=BANDS, rows=ROWS):
    """One hash for each band."""
    each = mix(drawn + mix(level.astype(np.uint64) + np.uint64(1))).reshape(bands, rows)
    key = mix(np.arange(bands, dtype=np.uint64))
    for k in range(rows):
        key = mix(key ^ each[:, k]) + np.uint64(k)
    return key


def digest(values, counts):
    """128 bits of the shingles and their counts: equal for equal multisets."""
    each = mix(values + mix(counts.astype(np.uint64)))
    return np.array([each.sum(dtype=np.uint64), mix(each ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)], "<u8").tobytes()


# ---- signatures -----------------------------------------------------------------------------------------------------

def _weigher(texts, common, total, rare, most):
    """How tasks find weights: the texts with a column ``common``, and a function of it, the shingles and their counts.

    The common shingles are broadcast if they are at most ``most``; otherwise each text gets its own by a join, which
    gives the same weights.
    """
    if common.count() <= most:
        rows = common.toPandas()
        shared = texts.sparkSession.sparkContext.broadcast(
            _Weights(rows["shingle"].to_numpy(np.int64), inverse_frequency(rows["frequency"].to_numpy(), total, rare)))
        return texts.withColumn("common", F.array().cast("array<struct<shingle:bigint,frequency:double>>")), lambda _, v, c: shared.value.of(v, c)

    def spread(batches):
        for batch in batches:
            for digest_, values in zip(batch["key"], shingles(batch["text"].tolist())):
                yield pd.DataFrame({"key": digest_, "shingle": np.unique(values >> np.uint64(16)).astype(np.int64)})

    own = texts.select("key", "text").mapInPandas(spread, "key bigint, shingle bigint").distinct().join(common, "shingle")
    own = own.groupBy("key").agg(F.collect_list(F.struct("shingle", "frequency")).alias("common"))  # a text's own shingles

    def weights(held, v, c):
        held = held if held is not None else []
        return _Weights(np.array([p["shingle"] for p in held], np.int64),
                        inverse_frequency(np.array([p["frequency"] for p in held], np.float64), total, rare)).of(v, c)

    return texts.join(own, texts["key"].eqNullSafe(own["key"]), "left").drop(own["key"]), weights


def _weighed_texts(batches, weights, width):
    """((id, text key), distinct shingles, counts, weights) of every text."""
    for batch in batches:
        for group in groups(rows_of(batch.select(["doc_id", "text_key", "text", "common"])), lambda x: len(x[2]), 1 << 20):
            for (*key, _, common), values in zip(group, shingles([g[2] for g in group], width)):
                values, counts = weighed(values)
                yield key, values, counts, weights(common, values, counts)


def _in_batches(rows, schema, size, most):
    """Arrow batches of rows; a batch ends when the sizes of its rows reach ``most``."""
    held, load = [], 0
    for row in rows:
        held.append(row)
        load += size(row)
        if load >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, load = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
    del held
    release()


def _signed(texts, weights, width, bands, rows, seed):
    """Of every text its digest, band keys and one byte of each sample."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("slots", pa.binary())])

    def signatures(batches):
        for key, values, counts, w in _weighed_texts(batches, weights, width):
            drawn, level = sample(values, w, bands * rows, seed)
            slots = (mix(drawn + level.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)
            keys = band_keys(drawn, level, bands, rows) if len(values) else np.empty(0, np.uint64)
            yield *key, digest(values, counts), keys.view(np.int64), slots.tobytes()

    return texts.mapInArrow(lambda batches: _in_batches(signatures(batches), schema, lambda row: 1, 5000), "doc_id bigint, text_key bigint, digest binary, bands array<bigint>, slots binary")


def _vectors(texts, weights, width):
    """Of every text its digest and its shingles with their weights."""
    schema = pa.schema([("digest", pa.binary()), ("shingles", pa.binary()), ("weights", pa.binary())])

    def vectors(batches):
        for _, values, counts, w in _weighed_texts(batches, weights, width):
            yield digest(values, counts), values.astype("<u8").tobytes(), w.astype("<f4").tobytes()

    return texts.mapInArrow(lambda batches: _in_batches(vectors(batches), schema, lambda row: len(row[1]), 4 << 20), "digest binary, shingles binary, weights binary")


# ---- verification ---------------------------------------------------------------------------------------------------

def weighted_jaccard(values_a, weights_a, values_b, weights_b):
    """Sum of the lesser weights over the sum of the greater ones; two empty texts are alike."""
    _, i, j = np.intersect1d(values_a, values_b, assume_unique=True, return_indices=True)
    both = np.minimum(weights_a[i], weights_b[j]).sum(dtype=np.float64)
    either = weights_a.sum(dtype=np.float64) + weights_b.sum(dtype=np.float64) - both
    return float(both / either) if either > 0 else 1.0


def _links_of(frame, threshold, alike):
    """Links among the texts of one cluster: enough of them to connect all that are alike."""
    slots, vectors, mass = _unpacked(frame)
    digests = frame["digest"].tolist()
    joined, found, least = _Joined(range(len(digests))), [], int(np.ceil(alike * slots.shape[1]))
    for i in range(len(digests) - 1):
        same = (slots[i + 1:] == slots[i]).sum(axis=1, dtype=np.int64)
        lesser, greater = np.minimum(mass[i], mass[i + 1:]), np.maximum(mass[i], mass[i + 1:])
        likely = (same >= least) & (lesser >= threshold * greater)
        for j in (np.flatnonzero(likely) + i + 1)[np.argsort(-same[likely], kind="stable")].tolist():
            if joined.top(i) != joined.top(j):
                similarity = weighted_jaccard(*vectors[i], *vectors[j])
                if similarity >= threshold:
                    joined.join(i, j)
                    found.append((digests[i], digests[j], similarity))
    return found


class _Joined:
    """Sets of keys, joined two at a time."""

    def __init__(self, keys):
        self.root = {k: k for k in keys}

    def top(self, k):
        root = self.root
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def join(self, a, b):
        self.root[self.top(b)] = self.top(a)


def _unpacked(frame):
    slots = np.stack([np.frombuffer(s, np.uint8) for s in frame["slots"]])
    vectors = [(np.frombuffer(s, "<u8"), np.frombuffer(w, "<f4")) for s, w in zip(frame["shingles"], frame["weights"])]
    return slots, vectors, np.array([w.sum(dtype=np.float64) for _, w in vectors])


def _verified(candidates, total, threshold, alike, block_size):
    """Links between the texts of each cluster; a task holds whole clusters."""
    bins = max(1, -(-total // (block_size // 2)))

    def compare(frame):
        found = [x for _, f in frame.groupby("cluster", sort=False) if len(f) > 1 for x in _links_of(f, threshold, alike)]
        return pd.DataFrame(found, columns=["a", "b", "similarity"])

    rows = candidates.withColumn("bin", F.pmod(F.xxhash64("cluster"), F.lit(bins)))
    return rows.groupBy("bin").applyInPandas(compare, "a binary, b binary, similarity double")


# ---- large clusters -------------------------------------------------------------------------------------------------

def _links_across(frame, threshold, alike):
    """Links between the texts marked ``first`` and the others, of unlike ``root``; a pair only in the first bucket it shares.

    Of two ``odd`` texts, which meet in both roles, the lesser is the first.
    """
    slots, vectors, mass = _unpacked(frame)
    digests, roots = frame["digest"].to_numpy(object), frame["root"].to_numpy(object)
    first, odd, band = frame["first"].to_numpy(bool), frame["odd"].to_numpy(bool), frame["band"].iloc[0]
    bands = None if pd.isna(band) else np.stack(frame["bands"].tolist())
    joined, found, least = _Joined(set(roots.tolist())), [], int(np.ceil(alike * slots.shape[1]))
    others = np.flatnonzero(~first)
    for i in np.flatnonzero(first).tolist():
        same = (slots[others] == slots[i]).sum(axis=1, dtype=np.int64)
        lesser, greater = np.minimum(mass[i], mass[others]), np.maximum(mass[i], mass[others])
        likely = (same >= least) & (lesser >= threshold * greater) & (roots[others] != roots[i])
        likely &= ~odd[others] | (digests[others] > digests[i])
        if bands is not None:
            shared = bands[others] == bands[i]
            likely &= bands[i][shared.argmax(axis=1)] == band
        for j in others[likely][np.argsort(-same[likely], kind="stable")].tolist():
            if joined.top(roots[i]) != joined.top(roots[j]):
                similarity = weighted_jaccard(*vectors[i], *vectors[j])
                if similarity >= threshold:
                    joined.join(roots[i], roots[j])
                    found.append((digests[i], digests[j], similarity))
    return pd.DataFrame(found, columns=["a", "b", "similarity"])


def _centres(places):
    """(digest, centre): each text with the centre of every bucket it is in; a centre shares the most buckets with others."""
    sized = places.join(written(places.groupBy("band").agg(F.count("*").alias("n")), "bucket-sizes"), "band")
    pull = written(sized.groupBy("digest").agg(F.sum("n").alias("pull")), "pulls")
    centre = places.join(pull, "digest").groupBy("band").agg(F.max(F.struct("pull", "digest")).alias("c"))
    centre = written(centre.select("band", F.col("c.digest").alias("centre")), "bucket-centres")
    return places.join(centre, "band").filter("digest != centre").select("digest", "centre").distinct()


def _left_over(places, roots, block_size):
    """Rows of the buckets whose texts are not all connected: (band, i, j, digest, root, first, odd).

    The most frequent root of such a bucket is its main one, and texts of other roots are odd. Odd texts, ``block_size`` to
    a block i, meet all texts of the bucket, ``block_size`` to a block j; so rows grow with the bucket times its odd blocks.
    """
    rooted = places.join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    rooted = written(rooted, "rooted-places")
    main = rooted.groupBy("band", "root").agg(F.count("*").alias("k")).groupBy("band").agg(
        F.sum("k").alias("n"), F.max(F.struct("k", "root")).alias("main"))
    main = main.filter("n > main.k").select("band", F.col("main.root").alias("main"), F.ceil((F.col("n") - F.col("main.k")) / block_size).cast("int").alias("odd_blocks"),
                                            F.ceil(F.col("n") / block_size).cast("int").alias("all_blocks"))
    rows = rooted.join(written(main, "mixed-buckets"), "band").withColumn("odd", F.col("root") != F.col("main"))
    place, side = F.xxhash64("digest"), ["band", "digest", "root", "odd"]
    every = rows.select(*side, F.lit(False).alias("first"), F.explode(F.sequence(F.lit(0), F.col("odd_blocks") - 1)).alias("i"), F.pmod(place, "all_blocks").cast("int").alias("j"))
    odd = rows.filter("odd").select(*side, F.lit(True).alias("first"), F.pmod(place, "odd_blocks").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("j"))
    return every.union(odd)


def _verified_large(texts, places, threshold, alike, block_size):
    """Links between texts of large clusters that share a bucket: with centres first, then between what these left apart.

    ``texts`` are stored (digest, slots, bands, shingles, weights), ``places`` their buckets. The first step grows with the
    number of texts. Texts of one bucket that it connects need no further comparison; all other pairs of a bucket are compared.
    """
    def across(frame):
        return _links_across(frame, threshold, alike)

    schema = "a binary, b binary, similarity double"
    pairs = written(_centres(places), "centre-pairs")
    parts = written(pairs.groupBy("centre").agg(F.ceil(F.count("*") / block_size).cast("int").alias("parts")), "centre-parts")
    others = pairs.join(parts, "centre").select("centre", F.pmod(F.xxhash64("digest"), "parts").cast("int").alias("part"), "digest", F.lit(False).alias("first"))
    centres = parts.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("centre").alias("digest"), F.lit(True).alias("first"))
    rows = others.union(centres).join(texts.drop("bands"), "digest")
    rows = rows.withColumns({"root": F.col("digest"), "odd": F.lit(False), "band": F.lit(None).cast("bigint")})
    near = written(rows.groupBy("centre", "part").applyInPandas(across, schema), "centre-links")

    rows = _left_over(places, components(near).select(F.col("node").alias("digest"), "root"), block_size).join(texts, "digest")
    return near.union(rows.groupBy("band", "i", "j").applyInPandas(across, schema))


# ---- the operator ---------------------------------------------------------------------------------------------------

def near_duplicates(docs, **settings):
    """Per row of ``docs``: ``doc_id`` and ``class_id``, the least id of all texts that it is linked to by near copies.

    Two texts are linked if their weighted Jaccard similarity is at least ``threshold``; classes are the connected
    components of the links. Texts with equal shingles and counts are one text. Null and empty texts, and texts without a
    letter or digit, are copies of each other; a text of fewer than ``width`` words has one shingle of them all. Repeated
    rows come back repeated, in one class. Null ids stay null and count after all others. Other columns are left out, so
    their names can't clash; an empty table gives an empty result. ``settings`` are those of ``classes``.
    Very long texts are compared by all their shingles; blocks of texts are bounded by their number, not by their length.
    """
    return classes(docs, **settings).select("doc_id", "class_id")


def _text_key(column):
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def classes(docs, threshold=THRESHOLD, width=WIDTH, bands=BANDS, rows=ROWS, rare=RARE, seed=SEED, most_broadcast=MOST_BROADCAST,
            block_size=BLOCK, samples_alike=SAMPLES_ALIKE, id_column="doc_id", text_column="text"):
    """Per row: ``doc_id``, ``text_key`` (a hash of the text), ``root`` (which names the class) and ``class_id``."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"),
                        _text_key(text_column).alias("text_key"))
    total, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()
    frequencies = _document_frequencies(texts, max(8, -(-size // (8 << 20))), width, rare)
    common = written(frequencies, "common-shingles", spark)
    keyed = texts.withColumn("key", F.xxhash64("doc_id", "text"))
    with_common, weights = _weigher(keyed, common, total, rare, most_broadcast)
    signed = written(_signed(with_common, weights, width, bands, rows, seed), "signatures", spark)

    distinct = signed.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.first("slots").alias("slots"))
    distinct = written(distinct, "distinct-texts", spark)
    members = distinct.select("digest", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.count("*").alias("n"), F.min("digest").alias("least")).filter("n > 1")
    clusters = components(members.join(buckets, "band").select(F.col("digest").alias("a"), F.col("least").alias("b")))

    clusters = clusters.select(F.col("node").alias("digest"), F.col("root").alias("cluster"))
    sizes = written(clusters.groupBy("cluster").agg(F.count("*").alias("n")), "cluster-sizes", spark)
    held = distinct.join(clusters.join(sizes, "cluster"), "digest")
    held = written(held.select("cluster", "n", "digest", "first_id", "slots"), "candidates", spark)

    def with_vectors(candidates):
        chosen = candidates.select("first_id").distinct()
        chosen = with_common.join(chosen, with_common["doc_id"].eqNullSafe(chosen["first_id"])).drop("first_id")
        return candidates.join(_vectors(chosen, weights, width).dropDuplicates(["digest"]), "digest")

    small, large = held.filter(F.col("n") <= block_size), held.filter(F.col("n") > block_size)
    links = _verified(with_vectors(small), small.count(), threshold, samples_alike, block_size)
    if not large.isEmpty():
        places = written(members.join(buckets, "band").select("band", "digest").join(large.select("digest"), "digest"), "places", spark)
        whole = written(with_vectors(large).join(distinct.select("digest", "bands"), "digest").select("digest", "slots", "bands", "shingles", "weights"), "large-clusters", spark)
        links = links.union(_verified_large(whole, places, threshold, samples_alike, block_size))
    links = written(links, "links", spark)

    roots = components(links).select(F.col("node").alias("digest"), "root")
    named = distinct.select("digest", "first_id").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    # stored, as in ``components``: the join can then split a class that holds a large part of all texts
    least = written(named.groupBy("root").agg(F.min("first_id").alias("class_id")), "class-ids", spark)
    named = named.join(least, "root").select("digest", "root", "class_id")
    return signed.select("doc_id", "text_key", "digest").join(named, "digest").drop("digest")


def deduplicated(docs, **settings):
    """One row of each class stays, with its own columns: the one with the least id, and of rows that share it one text.

    Unlike texts under one id are in classes of their own and stay. Null ids come after all others; of rows repeated in
    id and text one stays.
    """
    last = F.lit(2**63 - 1)
    found = classes(docs, **settings)
    kept = found.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", last).alias("_dedup_id"), F.col("text_key").alias("_dedup_text"))).alias("k"))
    keyed = docs.withColumns({"_dedup_id": F.coalesce(F.col("doc_id").cast("bigint"), last), "_dedup_text": _text_key("text")})
    rows = keyed.join(kept.select("k.*"), ["_dedup_id", "_dedup_text"], "left_semi")
    return rows.dropDuplicates(["_dedup_id", "_dedup_text"]).select(*docs.columns)
