"""Token ids in binary files of patched frame-of-reference blocks.

A file holds whole documents in ascending order of their ids. Layout, little-endian:

    magic "PFB1" | blocks | document table | index of block starts | footer

A block holds up to ``BLOCK`` ids: minimum (u4), count (u4), exceptions (u4), width (u1), then the packed residuals
(id minus minimum, ``width`` bits each), then the exceptions as two lists: positions (u2) and the full residuals (u4).
The width is the one that holds the ``PERCENTILE`` of residuals. The document table has the document id (i8), whether it
is null (u1) and the number of ids (u4) of each document; the index has the byte place of each block (u8). The footer has the number of
blocks and documents (u4 each) and the place of the document table (u8).
"""

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from plantwatch.llm.pieces import PieceIds, groups, has_safe_cuts, id_bytes, load
from plantwatch.llm.store import open_file, partitions, release, rows_of, shared_dir, write_file, written

MAGIC = b"PFB1"
BLOCK = 4096
PERCENTILE = 0.98
FILE_IDS = 2_000_000
HEAD, FOOT = struct.Struct("<IIIB"), struct.Struct("<IIQ")


# ---- blocks -------------------------------------------------------------------------------------------------------

def pack_block(ids, percentile=PERCENTILE):
    """Bytes of one block."""
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype("<u4")
    at = min(len(rest) - 1, int(np.ceil(percentile * len(rest))) - 1)
    width = int(np.partition(rest, at)[at]).bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    bits = np.unpackbits(rest.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    packed = np.packbits(bits.ravel(), bitorder="little").tobytes() if width else b""
    return b"".join([HEAD.pack(low, len(rest), len(odd), width), packed, odd.astype("<u2").tobytes(), rest[odd].tobytes()])


def unpack_block(data, start=0):
    """The ids of the block that starts there."""
    low, n, n_odd, width = HEAD.unpack_from(data, start)
    at, size = start + HEAD.size, (n * width + 7) // 8
    bits = np.zeros((n, 32), np.uint8)
    if width:
        packed = np.frombuffer(data, np.uint8, size, at)
        bits[:, :width] = np.unpackbits(packed, bitorder="little", count=n * width).reshape(n, width)
    rest = np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()
    odd = np.frombuffer(data, "<u2", n_odd, at + size)
    rest[odd] = np.frombuffer(data, "<u4", n_odd, at + size + 2 * n_odd)
    return rest + np.uint32(low)


def pack_file(documents, percentile=PERCENTILE):
    """The parts of one file; ``documents`` is a list of (id or None, ids as bytes)."""
    ids = np.frombuffer(b"".join(d[1] for d in documents), "<u4")
    parts, starts, place = [MAGIC], [], len(MAGIC)
    for k in range(0, len(ids), BLOCK):
        parts.append(pack_block(ids[k:k + BLOCK], percentile))
        starts.append(place)
        place += len(parts[-1])
    table = [np.array([d[0] or 0 for d in documents], "<i8"), np.array([d[0] is None for d in documents], "u1"),
             np.array([len(d[1]) // 4 for d in documents], "<u4"), np.array(starts, "<u8")]
    return [*parts, *[t.tobytes() for t in table], FOOT.pack(len(starts), len(documents), place)]


def read_file(data):
    """Document ids, null marks, id counts and a reader of any span of ids, which opens only the blocks it needs."""
    n_blocks, n_docs, place = FOOT.unpack_from(data, len(data) - FOOT.size)
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    keys = np.frombuffer(data, "<i8", n_docs, place)
    null = np.frombuffer(data, "u1", n_docs, place + 8 * n_docs)
    counts = np.frombuffer(data, "<u4", n_docs, place + 9 * n_docs)
    starts = np.frombuffer(data, "<u8", n_blocks, place + 13 * n_docs)

    @lru_cache(maxsize=2)
    def block(k):
        return unpack_block(data, int(starts[k]))

    def span(start, end):
        found = [block(k)[max(0, start - k * BLOCK):end - k * BLOCK] for k in range(start // BLOCK, -(-end // BLOCK))]
        return np.concatenate(found) if found else np.empty(0, "<u4")

    return keys, null, counts, span


# ---- tables -------------------------------------------------------------------------------------------------------

@lru_cache(maxsize=2)
def _cache(path):
    return PieceIds(load(path))


@lru_cache(maxsize=2)
def _tokenizer(path):
    return load(path)


def _encoded(texts, path, cuts):
    """Ids of each text as bytes."""
    if not cuts:
        return id_bytes(_tokenizer(path), texts)
    return _cache(path).of(texts)


def write_tokens(docs, path, folder=None, end_id=0, file_ids=FILE_IDS, percentile=PERCENTILE, id_column="doc_id", text_column="text"):
    """Encode every text, append ``end_id`` to each and write the files; gives the manifest, one row per file.

    Rows are range-partitioned and sorted by id (rows that share an id by text; null ids first), so a task writes its
    stretch of the order as files of about ``file_ids`` ids each; a document is never cut. A task that runs again writes
    the same files under the same names. Null texts are empty: they have the end id alone. Other columns are left out.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "token-files")
    cuts = has_safe_cuts(path)
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(partitions(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    rows = rows.select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def write(batches):
        shard, number, held, load = 0, 0, [], 0

        def flush():
            uri = write_file(folder, f"tokens-{shard:06d}-{number:05d}.pfb", pack_file(held, percentile))
            return pa.RecordBatch.from_pydict({"shard": [shard], "number": [number], "path": [uri], "n_documents": [len(held)], "n_ids": [load]}, schema=arrow)

        for batch in batches:
            for group in groups(rows_of(batch), lambda d: len(d[2]), 1 << 20):
                shard = group[0][0]
                for (_, key, _), ids in zip(group, _encoded([d[2] for d in group], path, cuts)):
                    held.append((key, ids + end))
                    load += len(ids) // 4 + 1
                    if load >= file_ids:
                        yield flush()
                        number, held, load = number + 1, [], 0
        if held:
            yield flush()
        held = []
        release()

    arrow = pa.schema([("shard", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_documents", pa.int64()), ("n_ids", pa.int64())])
    return written(rows.mapInArrow(write, "shard int, number int, path string, n_documents bigint, n_ids bigint"), "token-manifest", spark)


def read_tokens(manifest):
    """Per document, from the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    Only the manifest, one narrow row per file, is put in one order to find where each file starts.
    """
    shards = manifest.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("number")) - F.col("n_ids")
    files = manifest.select("shard", "number", "path", inside.alias("inside")).join(before, "shard")
    files = files.select("path", (F.col("shard_start") + F.col("inside")).alias("start"))
    files = files.repartition(max(partitions(manifest), 8), "path")

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with open_file(path) as f:
                    keys, null, counts, span = read_file(f.read())
                ends = np.cumsum(counts, dtype=np.int64)
                starts = ends - counts
                sums = [zlib.crc32(span(int(s), int(e)).tobytes()) for s, e in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=null.astype(bool)), pa.array(base + starts),
                                                  pa.array(counts.astype(np.int64)), pa.array(sums, pa.int64())],
                                                 names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs, path, **settings):
    """Write the files and read them back; see the two steps for repeated rows, nulls, empty texts and empty tables.

    Very long texts are encoded whole, one text at a time.
    """
    return read_tokens(write_tokens(docs, path, **settings))
