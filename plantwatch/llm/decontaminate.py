"""Test items inside documents: MinHash containment search over size partitions, verified by exact shingle containment.

Items are partitioned by their number of shingles, [2^c, 2^(c+1)). For a partition, documents are cut into windows of twice
its upper bound, a window starting at every bound, so any passage as long as an item lies whole in a window and the Jaccard
similarity of item and window cannot be far below the containment: at least 0.19 where 0.8 of an item is there. Item and
window are candidates if any of ``HASHES`` least hashes agrees, which a pair at 0.8 fails with a chance below 0.00001.
Candidates are verified by the share of the item's distinct shingles that the whole document has.

A window can agree only if it holds a shingle that is an item's least one, so signatures are taken of such windows only.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwatch.llm.pieces import groups
from plantwatch.llm.shingles import WIDTH, fold, mix, word_hashes
from plantwatch.llm.store import column_by_parts, kept_rows

THRESHOLD = 0.8
HASHES = 64
#: Items that are searched for together: what a task loads is bounded by this, and further items go in further passes.
ITEM_BLOCK = 4_000
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64))
_FILTER_BITS = 20


class _Items:
    """The items of one shingle width: their shingles, least hashes and window sizes."""

    def __init__(self, width, items):
        self.width, self.keys = width, [k for k, _ in items]
        self.shingles = [np.unique(s) for _, s in items]
        self.bounds = [1 << int(len(s)).bit_length() for s in self.shingles]
        least = np.stack([s[mix(s[:, None] ^ _SEEDS).argmin(axis=0)] for s in self.shingles])
        self.least = np.unique(least)
        self.of_least = {}
        for item, row in enumerate(least.tolist()):
            for number, shingle in enumerate(row):
                self.of_least.setdefault(shingle, []).append((item, number))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.least & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True

    def hits(self, runs):
        """Places of all shingles that are an item's least one."""
        at = np.flatnonzero(self.filter[(runs & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        near = np.minimum(np.searchsorted(self.least, runs[at]), len(self.least) - 1)
        return at[self.least[near] == runs[at]]

    def search(self, values, at, threshold):
        """(item, containment) of the items that the document with these shingles contains; ``at``: its hits."""
        tested, found, seen = {}, set(), set()
        for place in at.tolist():
            for item, number in self.of_least[int(values[place])]:
                bound = self.bounds[item]
                for window in {max(0, place // bound - 1), place // bound}:
                    if item in found or (key := (bound, window, number, int(values[place]))) in seen:
                        continue
                    seen.add(key)
                    if (mark := key[:3]) not in tested:
                        held = values[window * bound:(window + 2) * bound]
                        tested[mark] = held[mix(held ^ _SEEDS[number]).argmin()]
                    if tested[mark] == values[place]:
                        found.add(item)
        result = []
        for item in sorted(found):
            share = float(np.isin(self.shingles[item], values).sum() / len(self.shingles[item]))
            if share >= threshold:
                result.append((self.keys[item], share))
        return result


def _indexes(items, width):
    """Indexes for a list of (key, text), one for each shingle width; an item of fewer words has one shingle of them all."""
    hashes, counts = word_hashes([t for _, t in items])
    by_width = {}
    for (key, _), n, end in zip(items, counts.tolist(), np.cumsum(counts).tolist()):
        if n:
            by_width.setdefault(min(n, width), []).append((key, fold(hashes[end - n:end], min(n, width))))
    return [_Items(w, held) for w, held in sorted(by_width.items())]


def _contained(texts, indexes, threshold):
    """For each text the list of (item, containment)."""
    result = []
    for group in groups(texts, len, 1 << 20):
        hashes, counts = word_hashes(group)
        ends = np.cumsum(counts)
        found = [[] for _ in group]
        for index in indexes:
            runs = fold(hashes, index.width)
            hits = index.hits(runs)
            for k in np.unique(np.searchsorted(ends, hits, side="right")).tolist():
                start, stop = int(ends[k] - counts[k]), int(ends[k]) - index.width + 1
                at = hits[(hits >= start) & (hits < stop)] - start
                if len(at):
                    found[k] += index.search(runs[start:stop], at, threshold)
        result += found
    return result


def _finders(spark, items, threshold, width, block, item_column, item_text):
    """For each block of items a function from lists of texts to lists of (item, containment) lists, for tasks.

    All items are searched for, ``block`` of them at a time: the driver indexes one block after the other and a task loads
    the block of its function only. Documents never pass the driver. Items without a letter or digit, null ones included,
    are in no document.
    """
    held = items.select(F.col(item_column).cast("bigint").alias("k"), F.coalesce(F.col(item_text), F.lit("")).alias("t")).distinct()
    finders, pending = [], []

    def add():
        if indexes := _indexes(pending, width):
            shared = spark.sparkContext.broadcast(indexes)
            finders.append(lambda texts: _contained(texts, shared.value, threshold))

    for row in held.toLocalIterator():
        pending.append((row.k, row.t))
        if len(pending) == block:
            add()
            pending = []
    add()
    return finders or [lambda texts: [[] for _ in texts]]


def contaminations(docs, items, threshold=THRESHOLD, width=WIDTH, block=ITEM_BLOCK, id_column="doc_id", text_column="text",
                   item_column="item_id", item_text="text"):
    """A row for each document and item inside it: ``doc_id``, ``item_id`` and ``containment`` (at least the threshold).

    Null and empty texts hold nothing; a document of fewer words than an item's shingles have cannot hold it. Repeated
    document rows give repeated rows, repeated item rows count once. Null ids stay null. Other columns are left out,
    whatever their names; an empty table on either side gives an empty result. Very long texts are
    searched whole, one text at a time.
    """
    pair = pa.list_(pa.struct([("item_id", pa.int64()), ("containment", pa.float64())]))

    def searching(find):
        def search(batches):
            for batch in batches:
                found = column_by_parts(batch, "text", lambda texts: [[{"item_id": i, "containment": c} for i, c in x] for x in find(texts)], pair)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "found"])

        return search

    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    finders = _finders(docs.sparkSession, items, threshold, width, block, item_column, item_text)
    rows = reduce(DataFrame.union, [rows.mapInArrow(searching(f), "doc_id bigint, found array<struct<item_id:bigint,containment:double>>") for f in finders])
    return rows.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.item_id", "f.containment")


def without_items(docs, items, threshold=THRESHOLD, width=WIDTH, block=ITEM_BLOCK, text_column="text", item_column="item_id", item_text="text"):
    """The rows that hold no item, with their own columns. Of several blocks, each finds the texts that hold its items."""
    finders = _finders(docs.sparkSession, items, threshold, width, block, item_column, item_text)
    if len(finders) == 1:
        return kept_rows(docs, text_column, lambda texts: [not x for x in finders[0](texts)])
    texts = docs.select(F.col(text_column).alias("text"))
    holding = [kept_rows(texts, "text", lambda texts, find=find: [bool(x) for x in find(texts)]) for find in finders]
    holding = reduce(DataFrame.union, [h.select(F.sha2("text", 256).alias("_text_sha")) for h in holding]).distinct()
    return docs.withColumn("_text_sha", F.sha2(F.col(text_column), 256)).join(holding, "_text_sha", "left_anti").select(*docs.columns)


#: The same by definition, for items and documents of at least five words.
SQL = """
WITH doc_words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents),
item_words AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM benchmark),
doc_shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
                 FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM doc_words WHERE len(w) >= 5)),
item_shingles AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s
                  FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM item_words WHERE len(w) >= 5)),
sizes AS (SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id)
SELECT doc_id, item_id, count(*)::DOUBLE / any_value(n) AS containment
FROM doc_shingles JOIN item_shingles USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id HAVING count(*)::DOUBLE / any_value(n) >= 0.8
""".strip()
