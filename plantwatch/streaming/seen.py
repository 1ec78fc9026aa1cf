"""Repeats of any age: the ids of all events seen so far, found through one bitmap per event day.

A repeat is an event with an id and an event day that an earlier event had. Each day has a Bloom filter of its ids, kept as
bitmaps of 32,768 bits; a batch reads the filters of the days that it has events of, and no others. Only ids whose bits are all
set are then looked up among the day's ids, so a false hit costs a look-up and never an event. Each batch writes the ids it
kept, and the filters of its days with them, under its own number; a batch that runs again looks at earlier batches only.
"""

import re

from pyspark.sql import functions as F

HASHES = 3
IDS, FILTERS = "id string, day string, batch long", "bucket long, bitmap binary, day string, batch long"


def seen_ids(spark, path, days, batches):
    """Ids of these days from some batches (a condition on ``batch``); other days' folders are not read."""
    return spark.read.schema(IDS).parquet(f"{path}/ids").filter(F.col("day").isin(days) & batches)


def _newest_filters(spark, path, days, batch_id):
    """The filter of each of these days from the last batch before this one that wrote it; None if there is none."""
    folder = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/filters/{name}")
    system = folder("day").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    paths = []
    for day in days:
        names = [s.getPath().getName() for s in system.listStatus(folder(f"day={day}"))] if system.exists(folder(f"day={day}")) else []
        before = [int(m[1]) for n in names if (m := re.fullmatch(r"batch=(\d+)", n)) and int(m[1]) < batch_id]
        paths += [f"{path}/filters/day={day}/batch={n}" for n in sorted(before)[-1:]]
    return spark.read.schema(FILTERS).option("basePath", f"{path}/filters").parquet(*paths).drop("batch") if paths else None


def _bits(ids, bits):
    """The places of each id in its day's filter."""
    places = F.explode(F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(bits)) + 1 for k in range(HASHES)]))
    rows = ids.select("id", "day", places.alias("place"))
    return rows.select("id", "day", F.bitmap_bucket_number("place").alias("bucket"), F.bitmap_bit_position("place").cast("int").alias("bit"))


def suspects(ids, filters, bits):
    """Ids whose bits are all set: those that were seen, and a few that were not."""
    byte = F.conv(F.hex(F.expr("substring(bitmap, bit div 8 + 1, 1)")), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.expr("shiftleft(1, bit % 8)")) > 0
    hits = _bits(ids, bits).join(filters, ["day", "bucket"]).filter(is_set)
    return hits.groupBy("id", "day").agg(F.count("*").alias("n")).filter(F.col("n") == HASHES).drop("n")


def without_seen(rows, batch_id, path, id_column, day_column, bits=1 << 24):
    """The rows of a batch whose id no earlier batch had on that day, one of each; what was kept is noted under ``path``.

    ``id_column`` and ``day_column`` are column expressions. Rows without an id or a day are kept, as they can't be told
    apart. ``bits`` is the size of a day's filter; a full one costs look-ups, no events. Days are those of the events, so
    old folders can be deleted by day when no repeats of that age are expected.
    """
    spark = rows.sparkSession
    named = rows.withColumns({"_id": id_column.cast("string"), "_day": day_column.cast("string")})
    ids = named.select(F.col("_id").alias("id"), F.col("_day").alias("day")).dropna().distinct()
    days = [r[0] for r in ids.select("day").distinct().collect()]  # the event days of one batch
    if not days:
        return rows
    filters, fresh = _newest_filters(spark, path, days, batch_id), ids
    if filters is not None:
        earlier = seen_ids(spark, path, days, F.col("batch") < batch_id).drop("batch")
        fresh = ids.join(suspects(ids, filters, bits).join(earlier, ["id", "day"], "left_semi"), ["id", "day"], "left_anti")
    _written(fresh, f"{path}/ids", batch_id)
    kept = seen_ids(spark, path, days, F.col("batch") == batch_id).drop("batch")
    marks = _bits(kept, bits).groupBy("day", "bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))
    if filters is not None:
        marks = marks.unionByName(filters).groupBy("day", "bucket").agg(F.expr("bitmap_or_agg(bitmap)").alias("bitmap"))
    _written(marks, f"{path}/filters", batch_id)
    one = named.dropDuplicates(["_id", "_day"]).join(kept.select(F.col("id").alias("_id"), F.col("day").alias("_day")), ["_id", "_day"], "left_semi")
    return one.unionByName(named.filter("_id IS NULL OR _day IS NULL")).drop("_id", "_day")


def _written(df, path, batch_id):
    """Write a folder per day and batch; those of the same batch are replaced."""
    (df.withColumn("batch", F.lit(batch_id).cast("long")).hint("rebalance", "day").write.partitionBy("day", "batch").mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").parquet(path))
