"""Validating and curating streams."""

from pyspark import StorageLevel
from pyspark.sql import functions as F

from plantwatch.functions.times import event_time
from plantwatch.operators.curate import curate
from plantwatch.operators.diagnose import diagnose
from plantwatch.operators.partials import PARTIALS
from plantwatch.operators.validate import batch_counts, decode_stream, route, typed_events
from plantwatch.schema import PARTITION_COLUMNS, RAW
from plantwatch.sources.lake import batch_path, stream_raw_json, write_late, write_quarantine, write_raw
from plantwatch.streaming.presence import keep_state_in_rocksdb
from plantwatch.streaming.seen import without_seen


def without_repeats(decoded, delay="1 hour"):
    """Drop records whose event id was seen within the watermark delay; older stragglers are dropped too.

    Records without a readable time cannot be placed on the time line and pass untouched to the quarantine.
    A batch holds an id for each of its records, so the ids are kept in a state store on disk, not in the heap.
    """
    keep_state_in_rocksdb(decoded.sparkSession, large=True)
    stamped = decoded.withColumns({
        "_at": event_time(F.try_variant_get("record", "$.timestamp", "string")),
        "_id": F.coalesce(F.try_variant_get("record", "$.event_id", "string"), F.col("seq"))})
    timed = (stamped.filter("_at IS NOT NULL").withWatermark("_at", delay)
             .dropDuplicatesWithinWatermark(["_id"]).drop("_at", "_id"))
    return timed.unionByName(stamped.filter("_at IS NULL").drop("_at", "_id"))


def stream_validate(records, raw_path, quarantine_path, stats_path, checkpoint, dedup=False, delay="1 hour",
                    ingest_time=None, trigger=None, late_path=None, late_after=3600, seen_path=None):
    """Validate ``(seq, data)`` records, diagnose the valid ones and write raw, quarantine and batch counts.

    Each batch owns a folder named by its id and overwrites it, so a batch that is run again after a failure
    leaves one copy. Dates of the folders are ingest dates. Without ``dedup`` repeats reach the lake, as the
    sender's retries do.

    With ``late_path`` valid records whose event time is more than ``late_after`` seconds before the newest one of earlier
    batches go there, as JSON with the bound that they missed, and not to raw. The batch counts have ``late`` and the newest
    event time so far, from which the next batch takes its bound, so a batch that runs again has the same one. Use it
    without ``dedup``, whose operator drops such records itself; their number is in the query's progress.

    With ``seen_path`` valid records whose event id came before, however long ago, are dropped (see ``seen``) and counted as
    ``repeats``.
    """
    decoded = decode_stream(records)
    if dedup:
        decoded = without_repeats(decoded, delay)
    moment = F.current_timestamp() if ingest_time is None else F.lit(ingest_time).cast("timestamp")
    routed = route(decoded)

    def write(batch, batch_id):
        batch = _held(batch)
        try:
            at = event_time(F.try_variant_get("record", "$.timestamp", "string"))
            good, late, before = batch.filter("route = 'valid'"), F.lit(False), F.lit(None).cast("timestamp")
            if late_path:
                before = _newest_before(batch.sparkSession, stats_path, batch_id)
                bound = before - F.make_dt_interval(secs=F.lit(late_after))
                late = F.coalesce(at < bound, F.lit(False))
                write_late(good.filter(late), batch_path(late_path, batch_id), bound, moment)
            good, repeats = good.filter(~late), F.lit(0).cast("long")
            if seen_path:
                event_id, came = F.try_variant_get("record", "$.event_id", "string"), good.count()
                good = without_seen(good, batch_id, seen_path, event_id, F.date_format(at, "yyyy-MM-dd"))
                repeats = F.lit(came - good.count())
            write_raw(diagnose(typed_events(good)), batch_path(raw_path, batch_id), moment, mode="overwrite")
            write_quarantine(batch.filter("route <> 'valid'"), batch_path(quarantine_path, batch_id), moment, mode="overwrite")
            valid = F.col("route") == "valid"
            batch.agg(*batch_counts(), F.count_if(valid & late).alias("late"), F.greatest(F.max(F.when(valid, at)), before).alias("newest")).withColumn(
                "repeats", repeats).write.mode("overwrite").parquet(batch_path(stats_path, batch_id))
        finally:
            batch.unpersist()

    return (records_writer(routed, checkpoint, trigger).foreachBatch(write).start())


#: Rows of a cached block. A task holds up to a hundred blocks while Spark writes them to disk or reads them from there
#: (``spark.serializer.objectStreamReset``), and takes 2 KB a row for a variant column before it knows the sizes.
CACHED_ROWS = 200


def _held(routed):
    """The columns of routed records that the sinks read, kept on local disks: a task holds a few thousand rows, whatever a batch has.

    In memory the rows would compete with the sorts of the same tasks, which can't take back what a block in the making has.
    """
    routed.sparkSession.conf.set("spark.sql.inMemoryColumnarStorage.batchSize", CACHED_ROWS)  # of this stream's own session
    data = F.when(F.col("route") == "decode_error", F.col("data"))  # the others have it as ``record``
    return routed.drop("seq", "value").withColumn("data", data).persist(StorageLevel.DISK_ONLY)


def _newest_before(spark, stats_path, batch_id):
    """The newest event time of the batches before, as a literal, from the counts of the last one; null for the first batch."""
    newest = None
    if batch_id:
        last = spark.read.parquet(batch_path(stats_path, batch_id - 1))
        newest = last.agg(F.date_format(F.max("newest"), "yyyy-MM-dd HH:mm:ss")).first()[0]
    return F.lit(newest).cast("timestamp")


def records_writer(df, checkpoint, trigger=None, mode="append"):
    """Stream writer with a checkpoint; the default trigger handles what is there and stops."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True}))


RAW_BATCH = "raw_batch"


def _raw_batch():
    """The batch folder that a raw file lies in; empty for files that no validating stream wrote."""
    return F.regexp_extract(F.col("_metadata.file_path"), "/batch=([0-9]+)/", 1)


def stream_curate(spark, raw_path, curated_path, checkpoint, stats_path=None, trigger=None, files_per_trigger=None, views_path=None):
    """Curate raw files not yet seen into the partitioned table; one query is one active run.

    The table has a folder for each raw batch. New files only tell which raw batches changed: these are read as they are
    now and their folders overwritten. So a raw batch that was written again with the same records, as a validating
    stream does after a failure, leaves one copy of each, and so does a micro-batch that runs again. Files outside batch folders belong to the micro-batch that saw
    them. ``stats_path`` gets the rows read, kept and dropped per raw batch, overwritten in the same way.

    ``views_path`` gets the partial aggregates of the stored views per raw batch (``operators.partials``), replaced with it.

    Use ``trigger={"processingTime": "5 minutes"}`` to keep it running. Rebalancing splits a heavy type's day by size.
    """
    files = stream_raw_json(spark, raw_path, files_per_trigger).withColumn(RAW_BATCH, _raw_batch())

    def write(seen, batch_id):
        changed = [r[0] for r in seen.select(RAW_BATCH).distinct().collect()]  # batch numbers since the last trigger
        rows = seen.filter(F.col(RAW_BATCH) == "").withColumn(RAW_BATCH, F.lit(f"stream-{batch_id}"))
        folders = [batch_path(raw_path, b) for b in changed if b]
        if folders:
            again = spark.read.schema(RAW).option("recursiveFileLookup", "true").json(folders)
            rows = rows.unionByName(again.withColumn(RAW_BATCH, _raw_batch()))
        rows = rows.persist()  # the raw text is parsed once for all that is written
        try:
            kept = curate(rows, keep=[RAW_BATCH])
            _overwrite(kept.hint("rebalance", RAW_BATCH, *PARTITION_COLUMNS), curated_path, RAW_BATCH, *PARTITION_COLUMNS)
            if stats_path:
                counts = rows.groupBy(RAW_BATCH).agg(F.count("*").alias("rows_in")).join(
                    kept.groupBy(RAW_BATCH).agg(F.count("*").alias("rows_kept")), RAW_BATCH, "left")
                counts = counts.select(RAW_BATCH, "rows_in", F.coalesce("rows_kept", F.lit(0)).alias("rows_kept"))
                _overwrite(counts.withColumn("rows_dropped", F.col("rows_in") - F.col("rows_kept")), stats_path, RAW_BATCH)
            if views_path:
                for name, partial in PARTIALS.items():
                    _overwrite(partial(kept, RAW_BATCH).hint("rebalance", RAW_BATCH), f"{views_path}/{name}", RAW_BATCH)
        finally:
            rows.unpersist()

    return records_writer(files, checkpoint, trigger).foreachBatch(write).start()


def _overwrite(df, path, *partitions):
    """Write partitioned Parquet; only the partitions that ``df`` has are replaced."""
    (df.write.partitionBy(*partitions).mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "snappy").parquet(path))
