"""Merging the many small files of a curating stream into few, while the stream goes on.

The stream keeps a folder per raw batch and replaces it when the batch comes again (``live``). Merging copies the rows of new
and changed batches to ``merged``: partition folders of files near a target size, with the raw batch as a column. A
merge is a version. It writes only the partitions that it touches; its manifest says in which version each partition lies
and what each batch's files were called. The manifest is written last, so a version counts whole or not at all, and a
reader sees each row once at any time: a batch whose live files are those of the manifest is read from ``merged``, one that
was written again is read from ``live``, and its old rows are passed over.
"""

import os
import re

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from plantwatch.schema import CURATED, PARTITION_COLUMNS
from plantwatch.session import stored
from plantwatch.sources.lake import inventory_files, is_written

BATCH = "raw_batch"
ROWS = StructType([*CURATED.fields, StructField(BATCH, StringType())])
BATCHES, PARTS = f"{BATCH} string, files string", "part string, version int"


def _exists(spark, path):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(there)


def _names(spark, path):
    """Names of the folders in a path."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [s.getPath().getName() for s in system.listStatus(there) if s.isDirectory()] if system.exists(there) else []


def _deleted(spark, path):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(there, True)


def versions(spark, merged):
    """Numbers of the versions that were finished."""
    found = [int(m[1]) for name in _names(spark, merged) if (m := re.fullmatch(r"manifest=(\d+)", name))]
    return sorted(v for v in found if is_written(spark, f"{merged}/manifest={v}/parts"))


def _manifest(spark, merged, version):
    if version is None:
        return spark.createDataFrame([], BATCHES), spark.createDataFrame([], PARTS)
    return tuple(spark.read.schema(s).parquet(f"{merged}/manifest={version}/{name}") for s, name in ((BATCHES, "batches"), (PARTS, "parts")))


def _live_files(spark, live):
    """Batch, partition folder and size of the stream's files."""
    if not _names(spark, live):
        return spark.createDataFrame([], f"{BATCH} string, part string, name string, length long")
    files = inventory_files(spark, live).filter(F.col("path").endswith(".parquet"))
    place = rf"/{BATCH}=([^/]+)/(.+)/([^/]+)$"
    return files.select(*[F.regexp_extract("path", place, k).alias(n) for k, n in ((1, BATCH), (2, "part"), (3, "name"))], "length")


def _state(spark, live, merged, version):
    """The live files, and the batches whose live files the version doesn't have (new or written again)."""
    batches, parts = _manifest(spark, merged, version)
    files = stored(_live_files(spark, live), "live-files")
    now = files.groupBy(BATCH).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("/", "part", "name"))), "|"), 256).alias("files"))
    changed = now.join(batches.withColumnRenamed("files", "had"), BATCH, "left").filter("had IS NULL OR had <> files")
    return files, batches, parts, changed.select(BATCH, "files")


def _merged_rows(spark, merged, parts):
    """Rows of the merged partitions, with their raw batch."""
    folders = [f"{merged}/version={version}/{part}" for part, version in parts.collect()]  # one per partition folder of the table
    if not folders:
        return spark.createDataFrame([], ROWS)
    by_version = {}
    for folder in folders:
        by_version.setdefault(folder[len(merged) + 1:].split("/")[0], []).append(folder)
    rows = [spark.read.schema(ROWS).option("basePath", f"{merged}/{v}").parquet(*paths) for v, paths in by_version.items()]
    result = rows[0]
    for more in rows[1:]:
        result = result.unionByName(more)
    return result


def _live_rows(spark, live, batches):
    folders = [os.path.join(live, f"{BATCH}={b}") for b in batches]
    return spark.read.schema(ROWS).option("basePath", live).parquet(*folders) if folders else spark.createDataFrame([], ROWS)


def compacted_table(spark, live, merged):
    """All curated rows, each once, whatever was merged so far."""
    done = versions(spark, merged)
    _, _, parts, changed = _state(spark, live, merged, done[-1] if done else None)
    fresh = [r[0] for r in changed.select(BATCH).collect()]  # batches since the last merge
    return _without(_merged_rows(spark, merged, parts), fresh).unionByName(_live_rows(spark, live, fresh)).select(*CURATED.names)


def _without(rows, batches):
    return rows.filter(~F.col(BATCH).isin(batches)) if batches else rows


def _part_name():
    return F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in PARTITION_COLUMNS])


def compact(spark, live, merged, target_bytes=128 << 20):
    """Merge the batches that are new or were written again; returns the version, or None if there are none.

    Each touched partition folder is dealt to as many files as its bytes ask for. Partitions that hold no row of these
    batches stay in their version. Batches that are being written wait for the next merge, as their files aren't there yet.
    """
    done = versions(spark, merged)
    old, version = (done[-1] if done else None), (done[-1] + 1 if done else 1)
    files, batches, parts, changed = _state(spark, live, merged, old)
    changed = stored(changed, "changed-batches")
    fresh = [r[0] for r in changed.select(BATCH).collect()]
    if not fresh:
        return None
    before = _merged_rows(spark, merged, parts)
    new_parts = files.join(changed, BATCH).groupBy("part").agg(F.sum("length").alias("bytes"))
    held = before.filter(F.col(BATCH).isin(fresh)).select(_part_name().alias("part")).distinct().withColumn("bytes", F.lit(0).cast("long"))
    sizes = _merged_sizes(spark, merged, parts)
    touched = new_parts.union(held).groupBy("part").agg(F.sum("bytes").alias("bytes")).join(sizes, "part", "left")
    files_for = F.ceil((F.col("bytes") + F.coalesce("merged_bytes", F.lit(0))) / target_bytes)
    touched = touched.select("part", F.greatest(files_for, F.lit(1)).cast("int").alias("files"))
    before_it = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition folder
    touched = stored(touched.withColumn("first", F.coalesce(F.sum("files").over(before_it), F.lit(0))), "touched-parts")
    affected = parts.join(touched, "part", "left_semi")
    rows = _without(_merged_rows(spark, merged, affected), fresh).unionByName(_live_rows(spark, live, fresh))
    rows = rows.withColumn("part", _part_name()).join(touched, "part")
    rows = rows.withColumn("file", (F.col("first") + F.pmod(F.xxhash64("event_id"), F.col("files"))).cast("int"))
    # one task for each file, its events in order of time
    total = touched.agg(F.sum("files")).first()[0]
    dealt = rows.repartitionById(total, F.col("file")).sortWithinPartitions("timestamp").drop("part", "file", "files", "first")
    dealt.write.partitionBy(*PARTITION_COLUMNS).mode("overwrite").option("compression", "snappy").parquet(f"{merged}/version={version}")
    batches.join(changed, BATCH, "left_anti").union(changed.select(BATCH, "files")).write.mode("overwrite").parquet(f"{merged}/manifest={version}/batches")
    kept = parts.join(touched, "part", "left_anti")
    written = spark.read.parquet(f"{merged}/version={version}").select(_part_name().alias("part")).distinct().withColumn("version", F.lit(version))
    kept.union(written).coalesce(1).write.mode("overwrite").parquet(f"{merged}/manifest={version}/parts")
    return version


def _merged_sizes(spark, merged, parts):
    """Bytes of the merged partitions of a manifest."""
    if not any(name.startswith("version=") for name in _names(spark, merged)):
        return spark.createDataFrame([], "part string, merged_bytes long")
    files = inventory_files(spark, merged).select(F.regexp_extract("path", r"/version=(\d+)/", 1).alias("version"), F.regexp_extract("path", r"/version=\d+/(.+)/[^/]+$", 1).alias("part"), "length")
    files = files.filter("version <> ''").withColumn("version", F.col("version").cast("int"))
    return files.join(parts, ["part", "version"]).groupBy("part").agg(F.sum("length").alias("merged_bytes"))


def clean(spark, live, merged, keep_versions=1):
    """Delete what no reader of the last ``keep_versions`` versions needs: merged live folders, old manifests and partitions.

    A reader that began before has until then to finish. Returns how many folders went.
    """
    done = versions(spark, merged)
    if not done:
        return 0
    _, batches, _, changed = _state(spark, live, merged, done[-1])
    gone = [f"{live}/{BATCH}={r[0]}" for r in batches.join(changed, BATCH, "left_anti").collect()]
    kept = done[-keep_versions:]
    needed = {(r["version"], r["part"]) for v in kept for r in _manifest(spark, merged, v)[1].collect()}
    for v in done:
        if v not in kept:
            gone += [f"{merged}/version={v}/{r['part']}" for r in _manifest(spark, merged, v)[1].collect() if r["version"] == v and (v, r["part"]) not in needed]
            gone.append(f"{merged}/manifest={v}")
    gone = [folder for folder in gone if _exists(spark, folder)]
    for folder in gone:
        _deleted(spark, folder)
    return len(gone)
