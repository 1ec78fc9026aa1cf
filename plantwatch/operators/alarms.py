"""The documented alarms: a metric over its threshold in so many periods one after the other. Batch form; the stream has its own."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from plantwatch.rules import ALARMS


def preset(presets, field):
    """A field of the preset of a row's metric; null for metrics without one."""
    place = ("metric", "statistic", "threshold", "seconds", "periods").index(field)
    value = F.lit(None)
    for row in presets:
        value = F.when(F.col("metric") == row[0], F.lit(row[place])).otherwise(value)
    return value


def breaches(metrics, presets=ALARMS):
    """Periods of ``(metric, at, value)`` rows in which the metric exceeded its threshold: ``(metric, period)``, numbered by time."""
    period = F.floor(F.unix_timestamp("at") / preset(presets, "seconds")).alias("period")
    values = metrics.filter(F.col("metric").isin([p[0] for p in presets])).groupBy("metric", period).agg(F.sum("value").alias("sum"), F.max("value").alias("max"))
    value = F.when(preset(presets, "statistic") == "sum", F.col("sum")).otherwise(F.col("max"))
    return values.filter((value > preset(presets, "threshold")) & F.col("period").isNotNull()).select("metric", "period")


def alarm_changes(metrics, presets=ALARMS):
    """When each alarm goes on and off: ``(metric, changed_at, state, periods)``, state ``alarm`` or ``ok``.

    An alarm goes on at the end of the period that makes the breaches in a row enough, and off at the end of the first period
    without a breach; a period without values has none. ``periods`` counts the breaches in a row so far. Changes after
    the newest value of any metric haven't happened yet. The windows run over breaching periods, a row for each.
    """
    run = F.col("period") - F.row_number().over(Window.partitionBy("metric").orderBy("period"))
    runs = breaches(metrics, presets).withColumn("run", run).groupBy("metric", "run").agg(F.min("period").alias("first"), F.count("*").alias("n"))
    least, seconds = preset(presets, "periods"), preset(presets, "seconds")
    change = lambda state, period, n: F.struct(F.lit(state).alias("state"), (period * seconds).cast("long").alias("at"), n.cast("long").alias("periods"))
    on, off = change("alarm", F.col("first") + least, least), change("ok", F.col("first") + F.col("n") + 1, F.col("n"))
    changes = runs.filter(F.col("n") >= least).select("metric", F.explode(F.array(on, off)).alias("c")).select("metric", "c.*")
    newest = metrics.agg(F.unix_timestamp(F.max("at")).alias("n")).scalar()
    return changes.filter(F.col("at") <= newest).select("metric", F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("changed_at"), "state", "periods")
