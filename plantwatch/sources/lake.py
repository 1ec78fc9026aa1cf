"""Files of the lake: raw, quarantine, curated, replay and inventory."""

import os

from pyspark.sql import functions as F

from plantwatch.functions.numbers import exact_round
from plantwatch.functions.stages import staged
from plantwatch.functions.times import event_time
from plantwatch.operators.validate import parse_records, route, top_level
from plantwatch.schema import CURATED, DIAGNOSTIC_COLUMNS, PARTITION_COLUMNS, RAW


def read_raw_json(spark, path):
    """All JSON records below a path, whatever the machine type; a field no record has is null."""
    return spark.read.schema(RAW).option("recursiveFileLookup", "true").json(path)


def stream_raw_json(spark, path, files_per_trigger=None):
    """The same as a stream: only files not yet seen. A file that was replaced before it was read is passed over."""
    reader = spark.readStream.schema(RAW).option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def replay_events(spark, path, date=None, machine_id=None, suffix="*.{ndjson,json}"):
    """Events of dated folders in date, file and line order; blank and malformed lines are skipped."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).text(path)
    if date is not None:  # a condition on the path, so the files of other days are not opened
        lines = lines.filter(F.col("_metadata.file_path").rlike(f"/(date=)?{date}/"))
    lines = (lines.select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")))
    day = F.regexp_extract("file", r".*/(?:date=)?(\d{4}-\d{2}-\d{2})/", 1)
    events = lines.withColumn("event", F.try_parse_json("value")).filter("value <> '' AND event IS NOT NULL")
    if machine_id is not None:
        events = events.filter(F.try_variant_get("event", "$.machine_id", "string") == machine_id)
    return events.select(day.alias("date"), "value", "event", "file", "block", "line").orderBy(
        "date", "file", "block", "line").select("date", "value", "event")


def replay_dates(spark, path):
    """Dates there is something to replay for, sorted."""
    files = inventory_files(spark, path)
    day = F.regexp_extract("path", r".*/(?:date=)?(\d{4}-\d{2}-\d{2})/", 1)
    return files.select(day.alias("date")).filter("date <> ''").distinct().orderBy("date")


def write_rotated(df, path, seconds=300):
    """Compact JSON lines in a folder per date and time slot."""
    slot = F.timestamp_seconds(F.floor(F.unix_timestamp(event_time()) / seconds) * seconds)
    (df.withColumns({"date": F.date_format(slot, "yyyy-MM-dd"), "slot": F.date_format(slot, "HH-mm")})
     .hint("rebalance", "date", "slot").write.partitionBy("date", "slot").mode("append").json(path))


def write_curated(df, path, mode="append"):
    """Append to the curated table: Snappy Parquet by machine type and date, sorted by time inside the files.

    Rebalancing brings the rows of a folder together and splits a heavy folder over several tasks, by size.
    """
    (df.select(*CURATED.names).hint("rebalance", *PARTITION_COLUMNS)
     .sortWithinPartitions(*PARTITION_COLUMNS, "timestamp").write.partitionBy(*PARTITION_COLUMNS).mode(mode).option("compression", "snappy").parquet(path))


def curated_table(spark, path):
    """The curated table with its fixed schema; partition folders become columns.

    Reads what ``write_curated`` wrote and what the curating stream wrote, which has a folder per raw batch above them.
    """
    return spark.read.schema(CURATED).parquet(path).select(*CURATED.names)


def register_curated(spark, name, path):
    """Declare the curated folder as a table and load its partitions."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in CURATED)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
              f"PARTITIONED BY ({', '.join(PARTITION_COLUMNS)}) LOCATION '{path}'")
    spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


# ---- sinks of the validator ------------------------------------------------------------------------------------

def _date_parts(moment):
    return [F.date_format(moment, "yyyy").alias("year"), F.date_format(moment, "MM").alias("month"),
            F.date_format(moment, "dd").alias("day")]


def _merged(added):
    """JSON text of a record with further fields and without the producer's internal one."""
    extra = F.create_map(*[x for name, value in added.items() for x in (F.lit(name), value.cast("variant"))])
    dropped = [*added, "_enqueue_epoch"]
    kept = F.map_filter(top_level(), lambda k, _: ~k.isin(dropped))
    return F.to_json(F.map_concat(kept, extra)).alias("value")


def write_raw(valid, path, moment, mode="append"):
    """Valid, diagnosed events as JSON by machine type and ingest date; every field of the record is kept."""
    valid.select(
        _merged({n: F.col(n) for n in DIAGNOSTIC_COLUMNS}), "machine_type", *_date_parts(moment)
    ).write.partitionBy("machine_type", "year", "month", "day").mode(mode).text(path)


def write_quarantine(bad, path, moment, mode="append"):
    """Invalid events with the three validation fields, by ingest date and reason.

    Undecodable records go to the same place under ``decode_error`` as error, detail and raw data.
    """
    stamp = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    undecoded = F.to_json(F.struct(F.col("reason").alias("error"), "detail", F.coalesce("data", F.lit("")).alias("raw_data")))
    invalid = _merged({"_validation_error": F.col("reason"), "_validation_detail": F.col("detail"), "_quarantined_at": stamp})
    lost = F.col("route") == "decode_error"
    bad.select(
        F.when(lost, undecoded).otherwise(invalid).alias("value"), *_date_parts(moment),
        F.when(lost, "decode_error").otherwise(F.col("reason")).alias("reason")
    ).write.partitionBy("year", "month", "day", "reason").mode(mode).text(path)


def write_late(late, path, bound, moment, mode="overwrite"):
    """Valid records that came too late, with the bound that they missed, by ingest date."""
    missed = F.date_format(bound, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    late.select(_merged({"_late_before": missed}), *_date_parts(moment)).write.partitionBy("year", "month", "day").mode(mode).text(path)


def read_quarantine(spark, path, reason=None):
    """Quarantined records as text with their partition columns; ``reason`` skips the other folders."""
    rows = spark.read.option("basePath", path).schema(
        "value string, year string, month string, day string, reason string").text(path)
    return rows if reason is None else rows.filter(F.col("reason") == reason)


def reprocess_quarantine(rows, reason=None, required=None, limits=None):
    """Validate quarantined records again, without the fields the quarantine added."""
    if reason is not None:
        rows = rows.filter(F.col("reason") == reason)
    added = ("_validation_error", "_validation_detail", "_quarantined_at")
    clean = F.map_filter(top_level(), lambda k, _: ~k.isin(*added))
    again = parse_records(rows.select("value"))
    again = again.withColumn("record", F.coalesce(F.to_variant_object(clean), "record"))
    return route(again, required, limits)


# ---- inventory -------------------------------------------------------------------------------------------------

def inventory_files(spark, path):
    """Path, size and time of every file below a path; file contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select("path", "length", "modificationTime"))


def lake_inventory(spark, layers):
    """Files, bytes and newest change per layer, and how much smaller each is than the ``raw`` layer.

    ``layers`` maps a layer name to its path.
    """
    found = None
    for name, path in layers.items():
        files = inventory_files(spark, path).withColumn("layer", F.lit(name))
        found = files if found is None else found.unionByName(files)
    totals = found.groupBy("layer").agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("latest"))
    raw = totals.filter("layer = 'raw'").select("bytes").scalar()
    ratio = exact_round((1 - F.col("bytes") / F.col("raw_bytes")) * 100, 1)
    totals = staged(totals, raw_bytes=F.greatest(raw, F.lit(1)))
    return totals.withColumn("compression_ratio_pct", F.when(F.col("layer") != "raw", ratio)).drop("raw_bytes")


def batch_path(path, batch_id):
    return os.path.join(path, f"batch={batch_id}")


def is_written(spark, path):
    """Whether a write to this path was finished."""
    done = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(done)
