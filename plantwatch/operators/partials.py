"""The stored views kept up to date: partial aggregates per raw batch, merged when a view is read.

The curating stream writes the partials of each raw batch and replaces them when the batch is replaced, so a view over them
needs no scan of the events and follows late rows and replays. Sums, counts and ends merge exactly; distinct machines and
quantiles over any range of hours merge as sketches, with a bound on their error.
"""

from pyspark.sql import functions as F

from plantwatch.operators.aggregates import anomaly_count

MEASURES = ("temperature", "pressure", "power_consumption", "vibration", "degradation_level")
DAY = ("year", "month", "day")
#: Sizes of the sketches: up to 2^12 distinct machines are counted exactly, beyond with a relative error of about 1.6 %; a
#: quantile's rank is off by about 0.35 % at most.
MACHINES_LOG, LEVELS = 12, 800


def _rows():
    return [F.count("*").alias("events"), anomaly_count().alias("anomalies")]


def minute_partials(df, *keep):
    """Per machine and minute: rows, anomalies, and sum, count and greatest of the measures."""
    parts = [F.sum(c).alias(f"sum_{c}") for c in MEASURES] + [F.count(c).alias(f"n_{c}") for c in MEASURES]
    return df.groupBy(*keep, "machine_id", "machine_type", *DAY, F.substring("timestamp", 1, 16).alias("minute_bucket")).agg(
        *_rows(), *parts, F.max("degradation_level").alias("max_degradation_level"))


def anomaly_partials(df, *keep):
    """Per anomaly and machine type: rows, and sum and count of severities."""
    return df.filter("anomaly_detected").groupBy(*keep, "anomaly_type", "machine_type").agg(
        F.count("*").alias("events"), F.sum("anomaly_severity").alias("sum_severity"), F.count("anomaly_severity").alias("n_severity"))


def sketch_partials(df, *keep):
    """Per hour: rows, anomalies, and sketches of the machines and of the degradation levels."""
    return df.groupBy(*keep, F.substring("timestamp", 1, 13).alias("hour_bucket")).agg(
        *_rows(), F.sum("degradation_level").alias("sum_level"), F.count("degradation_level").alias("n_level"),
        F.theta_sketch_agg("machine_id", MACHINES_LOG).alias("machines"), F.kll_sketch_agg_double("degradation_level", LEVELS).alias("levels"))


def day_partials(df, *keep):
    """Zone map: per machine and day the first and the last event and the number of rows."""
    return df.groupBy(*keep, "machine_id", *DAY).agg(F.min("timestamp").alias("first_event"), F.max("timestamp").alias("last_event"), F.count("*").alias("events"))


PARTIALS = {"minutes": minute_partials, "anomalies": anomaly_partials, "hours": sketch_partials, "days": day_partials}


def partials(spark, path, name):
    """The stored partials of all raw batches."""
    return spark.read.parquet(f"{path}/{name}")


def _merged(name):
    return F.sum(name).cast("long")


def _mean(column):
    return (F.sum(f"sum_{column}") / F.sum(f"n_{column}")).alias(f"avg_{column}")


def machine_health(minutes):
    """``machine_health_view`` from minute partials."""
    rate = (F.sum("anomalies") * 100.0 / F.sum("events")).alias("anomaly_rate_percent")
    return minutes.groupBy("machine_id", "machine_type").agg(
        _merged("events").alias("total_events"), _merged("anomalies").alias("anomaly_events"), rate, _mean("temperature"),
        F.max("max_degradation_level").alias("max_degradation_level"))


def _factory(minutes, *keys):
    return minutes.groupBy(*keys).agg(_merged("events").alias("total_events"), F.count_distinct("machine_id").alias("active_machines"),
                                      _merged("anomalies").alias("total_anomalies"), _mean("degradation_level"))


def daily_summary(minutes):
    return _factory(minutes, *DAY)


def hourly_summary(minutes):
    return _factory(minutes, F.substring("minute_bucket", 1, 13).alias("hour_bucket"))


def timeseries(minutes):
    return minutes.groupBy("machine_id", "machine_type", "minute_bucket").agg(
        _merged("events").alias("event_count"), *[_mean(c) for c in MEASURES], _merged("anomalies").alias("anomaly_count"))


def anomaly_summary(anomalies):
    return anomalies.groupBy("anomaly_type", "machine_type").agg(_merged("events").alias("anomaly_count"),
                                                                (F.sum("sum_severity") / F.sum("n_severity")).alias("avg_anomaly_severity"))


def range_summary(hours, start=None, end=None, by=10):
    """Sketches of hours merged: per ``by`` characters of the hour (10 a day, 7 a month, 0 all) in ``[start, end)``.

    ``active_machines`` and the quartiles of the level are estimates; see the sizes of the sketches.
    """
    if start is not None:
        hours = hours.filter(F.col("hour_bucket") >= start)
    if end is not None:
        hours = hours.filter(F.col("hour_bucket") < end)
    levels = F.kll_merge_agg_double("levels")
    rows = hours.groupBy(F.substring("hour_bucket", 1, by).alias("time_bucket")).agg(
        _merged("events").alias("total_events"), F.theta_sketch_estimate(F.theta_union_agg("machines", MACHINES_LOG)).alias("active_machines"),
        _merged("anomalies").alias("total_anomalies"), (F.sum("sum_level") / F.sum("n_level")).alias("avg_degradation_level"), levels.alias("l"), _merged("n_level").alias("n"))
    quartiles = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("l", F.lit(q))).alias(name) for q, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]
    return rows.select(*[c for c in rows.columns if c not in ("l", "n")], *quartiles)


def newest_events(days):
    """Newest event text per machine from the zone map, for ``machine_history``."""
    return days.groupBy("machine_id").agg(F.max("last_event").alias("newest"))


def machine_days(days, machine_id):
    """The days on which a machine had events, by the zone map: a condition on the date columns, which skips folders."""
    found = days.filter(F.col("machine_id") == machine_id).select(*DAY).distinct().collect()  # the days of one machine
    by_month = {}
    for year, month, day in found:
        by_month.setdefault((year, month), []).append(day)
    wanted = F.lit(False)
    for (year, month), of_month in sorted(by_month.items()):
        wanted = wanted | ((F.col("year") == year) & (F.col("month") == month) & F.col("day").isin(sorted(of_month)))
    return wanted
