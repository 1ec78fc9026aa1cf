"""Stored aggregates and views over the curated table (one scan and one shuffle each, combined before the shuffle)."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from plantwatch.functions.numbers import exact_round, percent_of
from plantwatch.functions.times import BUCKET_WIDTH

def anomaly_count():
    """Aggregate: anomalous rows; a missing flag counts as none."""
    return F.count_if(F.coalesce(F.col("anomaly_detected"), F.lit(False)))


def _energy(*names):
    total = F.lit(0.0)
    for name in names:
        total = total + F.coalesce(F.col(name), F.lit(0.0))
    return total


def _status_counts():
    return [
        F.count("*").alias("total_events"),
        anomaly_count().alias("anomaly_count"),
        F.count_if(F.col("status") == "healthy").alias("healthy_count"),
        F.count_if(F.col("status") == "warning").alias("warning_count"),
        F.count_if(F.col("status").isin("critical", "anomaly")).alias("critical_count"),
    ]


def count_by_type(df):
    return df.groupBy("machine_type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "machine_type")


def avg_temp_by_machine(df):
    return (df.groupBy("machine_id").agg(F.avg("temperature").alias("avg_temp"))
            .orderBy(F.desc_nulls_last("avg_temp"), "machine_id"))


def anomaly_trend(df):
    return (df.filter("anomaly_detected").groupBy("anomaly_type").agg(F.count("*").alias("anomaly_count"))
            .orderBy(F.desc("anomaly_count"), "anomaly_type"))


def most_active(df, limit=10):
    return (df.groupBy("machine_id", "machine_type").agg(F.count("*").alias("event_count"))
            .orderBy(F.desc("event_count"), "machine_id").limit(limit))


def avg_temp_by_type(df):
    return (df.groupBy("machine_type").agg(F.avg("temperature").alias("avg_temp"))
            .orderBy(F.desc_nulls_last("avg_temp"), "machine_type"))


def _rates():
    return [
        F.count("*").alias("total_events"),
        anomaly_count().alias("anomaly_events"),
        (anomaly_count().cast("double") / F.count("*") * 100.0).alias("anomaly_rate_percent"),
    ]


def anomaly_rate(df):
    return (df.groupBy("machine_id", "machine_type").agg(*_rates())
            .orderBy(F.desc("anomaly_rate_percent"), F.desc("total_events"), "machine_id"))


def daily_volume(df):
    return (df.groupBy("year", "month", "day").agg(F.count("*").alias("daily_volume"))
            .orderBy(F.desc("year"), F.desc("month"), F.desc("day")))


def energy_by_type(df):
    return (df.groupBy("machine_type")
            .agg(F.sum(_energy("power_consumption", "energy_usage", "energy_output")).alias("total_energy_units"))
            .orderBy(F.desc("total_energy_units"), "machine_type"))


def machine_health_view(df):
    return df.groupBy("machine_id", "machine_type").agg(
        *_rates(), F.avg("temperature").alias("avg_temperature"), F.max("degradation_level").alias("max_degradation_level"))


def anomaly_summary_view(df):
    return df.filter("anomaly_detected").groupBy("anomaly_type", "machine_type").agg(
        F.count("*").alias("anomaly_count"), F.avg("anomaly_severity").alias("avg_anomaly_severity"))


def _factory_summary(df, *keys, approximate=False):
    machines = F.approx_count_distinct("machine_id") if approximate else F.count_distinct("machine_id")
    return df.groupBy(*keys).agg(
        F.count("*").alias("total_events"), machines.alias("active_machines"),
        anomaly_count().alias("total_anomalies"), F.avg("degradation_level").alias("avg_degradation_level"))


def daily_summary_view(df, approximate=False):
    return _factory_summary(df, "year", "month", "day", approximate=approximate)


def hourly_summary_view(df, approximate=False):
    return _factory_summary(df, F.substring("timestamp", 1, 13).alias("hour_bucket"), approximate=approximate)


def timeseries_view(df):
    return df.groupBy("machine_id", "machine_type", F.substring("timestamp", 1, 16).alias("minute_bucket")).agg(
        F.count("*").alias("event_count"),
        *[F.avg(c).alias(f"avg_{c}") for c in
          ("temperature", "pressure", "power_consumption", "vibration", "degradation_level")],
        anomaly_count().alias("anomaly_count"))


VIEWS = {
    "machine_health_view": machine_health_view,
    "anomaly_summary_view": anomaly_summary_view,
    "daily_factory_summary_view": daily_summary_view,
    "hourly_factory_summary_view": hourly_summary_view,
    "telemetry_timeseries_view": timeseries_view,
}


def register_views(df):
    """The five named views as temporary views of the session."""
    for name, view in VIEWS.items():
        view(df).createOrReplaceTempView(name)
    return list(VIEWS)


def temperature_sum(df, machine_type=None, year=None, month=None, day=None):
    """Sum of temperature, over everything or over the partitions named."""
    wanted = {"machine_type": machine_type, "year": year, "month": month, "day": day}
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df.agg(F.sum("temperature").alias("sum_temperature"))


def energy_profile(df):
    profile = df.groupBy("machine_type").agg(
        F.sum(_energy("power_consumption", "energy_usage", "energy_output")).alias("energy"),
        F.avg(_energy("power_consumption", "energy_usage")).alias("power"),
        F.count("*").alias("event_count"))
    return (profile.select(F.coalesce("machine_type", F.lit("unknown")).alias("machine_type"),
                           exact_round(F.col("energy"), 2).alias("total_energy"),
                           exact_round(F.col("power"), 2).alias("avg_power"), "event_count")
            .orderBy(F.desc("total_energy"), "machine_type"))


def activity_counts(df, grain):
    """Event, anomaly and status counts per time bucket (``grain``: minute, hour or day)."""
    return df.groupBy(F.substring("timestamp", 1, BUCKET_WIDTH[grain]).alias("time_bucket")).agg(*_status_counts())


def hourly_trends(df, buckets=None, grain="hour", latest=False):
    """Counts of every hour, or of every minute or day with another ``grain``.

    ``buckets`` keeps only so many for a report, the oldest or the ``latest``; by default all are kept.
    """
    counts = activity_counts(df, grain)
    if buckets is not None:
        counts = counts.orderBy(F.desc("time_bucket") if latest else F.asc("time_bucket")).limit(buckets)
    label = F.replace("time_bucket", F.lit("T"), F.lit(" "))
    if grain == "hour":
        label = F.concat(label, F.lit(":00"))
    return counts.select(
        label.alias("time_label"), "total_events", "anomaly_count",
        exact_round(percent_of(F.col("anomaly_count"), F.col("total_events")), 2).alias("anomaly_rate_pct"),
        "healthy_count", "warning_count", "critical_count").orderBy("time_label")


def trend_shift(trends, threshold=0.5):
    """Mean anomaly rate of the last third of the buckets minus that of the first third, and its direction.

    Takes the rows of ``hourly_trends``, one for each hour: about nine thousand a year, whatever the number of events.
    """
    thirds = trends.withColumn("third", F.ntile(3).over(Window.orderBy("time_label")))
    mean = thirds.agg(
        F.avg(F.when(F.col("third") == 1, F.col("anomaly_rate_pct"))).alias("early_rate"),
        F.avg(F.when(F.col("third") == 3, F.col("anomaly_rate_pct"))).alias("recent_rate"),
        F.sum("total_events").alias("total_events"), F.sum("anomaly_count").alias("total_anomalies"))
    delta = F.col("recent_rate") - F.col("early_rate")
    return mean.withColumn("delta", delta).withColumn(
        "direction", F.when(delta >= threshold, "rising").when(delta <= -threshold, "falling").otherwise("steady"))


def daily_records(df):
    """The daily view with ISO dates, newest first."""
    view = daily_summary_view(df)
    return view.select(
        F.format_string("%d-%02d-%02d", "year", "month", "day").alias("date"), "total_events", "active_machines",
        "total_anomalies", F.coalesce("avg_degradation_level", F.lit(0.0)).alias("avg_degradation_level")
    ).orderBy(F.desc("date"))


def anomaly_distribution(df):
    """The anomaly view with ``unknown`` for missing names, largest first."""
    return anomaly_summary_view(df).select(
        F.coalesce("anomaly_type", F.lit("unknown")).alias("anomaly_type"),
        F.coalesce("machine_type", F.lit("unknown")).alias("machine_type"), "anomaly_count",
        F.coalesce("avg_anomaly_severity", F.lit(0.0)).alias("avg_anomaly_severity")
    ).orderBy(F.desc("anomaly_count"), "anomaly_type", "machine_type")


def anomaly_share(df, top=5):
    """The largest anomaly groups and their rounded share among themselves."""
    largest = anomaly_distribution(df).limit(top)
    total = largest.agg(F.greatest(F.sum("anomaly_count"), F.lit(1)).alias("n")).scalar()
    return largest.select(
        F.replace("anomaly_type", F.lit("_"), F.lit("")).alias("name"), "machine_type",
        F.col("anomaly_count").alias("count"),
        F.floor(F.col("anomaly_count") / total * 100 + 0.5).cast("bigint").alias("percentage"))


def telemetry_profile(df):
    """Row counts by type, status and anomaly flag, and by machine: ``(section, name, rows)``; one scan."""
    sets = df.withColumn("flag", F.col("anomaly_detected").cast("string")).groupingSets(
        [["machine_type"], ["status"], ["flag"]], "machine_type", "status", "flag"
    ).agg(F.count("*").alias("rows"), F.grouping_id().alias("gid"))
    section = F.when(F.col("gid") == 3, "machine_type").when(F.col("gid") == 5, "status").otherwise("anomaly_detected")
    return sets.select(section.alias("section"), F.coalesce("machine_type", "status", "flag").alias("name"), "rows")


def exact_percentiles(df, column, shares, max_values=1_000_000, fineness=10_000):
    """Percentiles of a column with interpolation, as a list of numbers (nulls where there are no values), over any range of values.
    NaN counts as no value.

    Each percentile is bracketed: an approximate one a little below and a little above hold its place between them, and the
    values below the bracket are counted. The bracket is drawn closer, a scan of the values each time, until few values are
    in it or it is one value that very many rows share; then its values are counted one by one and the place found.
    """
    values = df.select(F.col(column).cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)")
    n, low, high = values.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return [None] * len(shares)
    brackets = [(low, high, 0, n)] * len(shares)  # ends, values below, values inside
    places = [share * (n - 1) for share in shares]
    inside = lambda b: F.col("x").between(F.lit(b[0]), F.lit(b[1]))
    while any(b[0] != b[1] and b[3] > max_values for b in brackets):
        asked = []
        for place, b in zip(places, brackets):
            near = (place - b[2]) / max(1, b[3])
            ends = [min(1.0, max(0.0, near + side * 2.0 / fineness)) for side in (-1, 1)]
            asked.append(F.percentile_approx(F.when(inside(b), F.col("x")), ends, fineness))
        ends = values.agg(*[a.alias(str(k)) for k, a in enumerate(asked)]).first()
        tried = [(max(b[0], e[0]), min(b[1], e[1])) for b, e in zip(brackets, ends)]
        counts = values.agg(*[F.count_if(f) for t in tried for f in (F.col("x") < F.lit(t[0]), inside(t))]).first()
        closer = []
        for k, (place, b, t) in enumerate(zip(places, brackets, tried)):
            below, here = counts[2 * k], counts[2 * k + 1]
            holds = below <= math.floor(place) and math.ceil(place) < below + here
            closer.append((*t, below, here) if holds else b)
        if closer == brackets:  # the rest are values that many rows share
            break
        brackets = closer
    found = []
    for place, b in zip(places, brackets):
        counted = values.filter(inside(b)).groupBy("x").agg(F.count("*").alias("n"))
        upto = counted.withColumn("upto", F.sum("n").over(Window.orderBy("x")) + b[2])
        first, second = (F.min(F.when(F.col("upto") > k, F.col("x"))) for k in (math.floor(place), math.ceil(place)))
        lower, upper = upto.agg(first, second).first()
        found.append(lower + (upper - lower) * (place - math.floor(place)))
    return found


def degradation_profile(df):
    """Count, mean, spread, range and quartiles of the degradation level, exact for levels of any range."""
    quartiles = exact_percentiles(df, "degradation_level", (0.25, 0.5, 0.75))
    level = F.col("degradation_level")
    return df.agg(F.count(level).alias("count"), F.avg(level).alias("mean"), F.stddev(level).alias("std"), F.min(level).alias("min"),
                  *[F.lit(q).cast("double").alias(name) for q, name in zip(quartiles, ("p25", "p50", "p75"))], F.max(level).alias("max"))
