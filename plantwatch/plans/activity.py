"""Telemetry activity over a window that ends at the newest event, compared with the period before."""

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from plantwatch import rules
from plantwatch.functions.numbers import exact_round, fixed_text, percent_of
from plantwatch.functions.text import filled, title_words
from plantwatch.functions.times import bound_text, bucket_label, event_time, parse_text, time_ends, time_range


def suggested_window(seconds):
    return F.when(seconds < 900, "15m").when(seconds < 7200, "1h").when(seconds < 172800, "24h").otherwise("7d")


def time_span(df):
    """Oldest and newest event, span, suggested window and progress towards a full day of data."""
    ends = time_ends(df).select(F.col("oldest").alias("min_timestamp"), F.col("newest").alias("max_timestamp"))
    span = F.greatest((F.unix_timestamp(event_time(F.col("max_timestamp")))
                       - F.unix_timestamp(event_time(F.col("min_timestamp")))).cast("double"), F.lit(1.0))
    rows = ends.withColumn("time_span_seconds", span)
    span = F.col("time_span_seconds")
    return rows.select(
        "min_timestamp", "max_timestamp", "time_span_seconds", suggested_window(span).alias("suggested_window"),
        F.least(F.lit(100.0), exact_round(span / 86400.0 * 100.0, 1)).alias("collection_progress_pct"),
        F.when(span < 86400.0, F.greatest(F.lit(0.0), exact_round((86400.0 - span) / 60.0, 1))).otherwise(0.0)
        .alias("estimated_time_remaining_minutes"))


@dataclass(frozen=True)
class Period:
    """A window ending at the newest event, and the equal period before it."""

    window: str
    prior_start: datetime
    start: datetime
    end: datetime

    @property
    def seconds(self):
        return rules.WINDOWS[self.window][0]


def activity_period(df, window="24h"):
    """Bounds of the window, from one small aggregate. An unknown window name gives the suggested one.

    The bounds are fixed values afterwards, so the scans that use them skip partitions and row groups.
    """
    row = time_span(df).first()
    end = parse_text(row["max_timestamp"])
    if end is None:
        raise ValueError("no readable timestamp in the table")
    name = window if window in rules.WINDOWS else row["suggested_window"]
    length = timedelta(seconds=rules.WINDOWS[name][0])
    return Period(name, end - 2 * length, end - length, end)


def activity_base(df, period):
    """Counts by bucket, machine type and period; the one scan all activity results are rolled up from."""
    width = rules.WINDOWS[period.window][1]
    rows = time_range(df, period.prior_start, period.end)
    current = (F.col("timestamp") >= bound_text(period.start)).alias("current")
    status = lambda *s: F.count_if(F.col("status").isin(*s))
    return rows.groupBy(current, F.substring("timestamp", 1, width).alias("time_bucket"), "machine_type").agg(
        F.count("*").alias("total_events"),
        F.count_if(F.coalesce("anomaly_detected", F.lit(False))).alias("anomaly_count"),
        status("healthy").alias("healthy_count"), status("warning").alias("warning_count"),
        status("critical", "anomaly").alias("critical_count"))


_COUNTS = ("total_events", "anomaly_count", "healthy_count", "warning_count", "critical_count")


def activity_series(base, period):
    """Counts per bucket of the current window, with axis labels."""
    return base.filter("current").groupBy("time_bucket").agg(*[F.sum(c).alias(c) for c in _COUNTS]).select(
        "time_bucket", bucket_label(F.col("time_bucket"), period.window).alias("time_label"), *_COUNTS
    ).orderBy("time_bucket")


def activity_kpis(base, period):
    """Totals, rates, peak and trend against the period before (0 when that was empty)."""
    minutes_per_bucket = rules.WINDOWS[period.window][2]
    per_bucket = base.groupBy("current", "time_bucket").agg(F.sum("total_events").alias("n"), F.sum("anomaly_count").alias("a"))
    now = F.col("current")
    sums = per_bucket.agg(
        F.coalesce(F.sum(F.when(now, F.col("n"))), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum(F.when(now, F.col("a"))), F.lit(0)).alias("anomalies"),
        F.coalesce(F.max(F.when(now, F.col("n"))), F.lit(0)).alias("peak"),
        F.coalesce(F.sum(F.when(~now, F.col("n"))), F.lit(0)).alias("prior"))
    total = F.col("total_events")
    return sums.select(
        "total_events", exact_round(total / (period.seconds / 60.0), 1).alias("telemetry_rate_per_min"),
        exact_round(F.col("peak") / minutes_per_bucket, 1).alias("peak_rate_per_min"),
        exact_round(percent_of(F.col("anomalies"), total), 1).alias("anomaly_rate_pct"),
        F.when(F.col("prior") > 0, exact_round((total - F.col("prior")) / F.col("prior") * 100.0, 1)).otherwise(0.0)
        .alias("trend_pct"))


def activity_breakdown(base):
    """Events per machine type with their share; largest first."""
    by_type = base.filter("current").groupBy("machine_type").agg(F.sum("total_events").alias("event_count"))
    total = F.sum("event_count").over(Window.partitionBy())
    return by_type.withColumn("total", total).select(
        title_words(F.coalesce("machine_type", F.lit("unknown"))).alias("machine_type"), "event_count",
        exact_round(F.col("event_count") / F.col("total") * 100.0, 1).alias("percentage")
    ).orderBy(F.desc("event_count"), "machine_type")


def pipeline_freshness(df, now):
    """State of each pipeline part by the age of the newest event at ``now`` (a datetime in UTC)."""
    age = F.greatest(F.unix_timestamp(F.lit(now.strftime("%Y-%m-%d %H:%M:%S"))) - F.unix_timestamp(event_time(F.col("newest"))),
                     F.lit(0)).cast("double")
    rows = time_ends(df).select(age.alias("age"))
    age = F.col("age")
    live = lambda word: F.when(age < 300.0, word).otherwise("inactive")
    return rows.select(
        F.when(age < 45.0, "active").when(age < 300.0, "idle").otherwise("inactive").alias("producer"),
        live("streaming").alias("stream"), live("processing").alias("validator"),
        F.lit("operational").alias("etl"), F.lit("queryable").alias("query_engine"),
        exact_round(age, 1).alias("freshness_seconds"))


def activity_insights(kpis, breakdown):
    """Texts on trend, anomalies and the most active type: one row with an array."""
    trend, rate = F.col("trend_pct"), F.col("anomaly_rate_pct")
    top = breakdown.agg(F.min(F.struct((-F.col("event_count")).alias("k"), "machine_type", "percentage")).alias("t"))
    leader = top.filter("t IS NOT NULL").select(
        filled(rules.ACTIVITY_LEADER, kind=F.col("t.machine_type"), share=fixed_text(F.col("t.percentage"), 1))).scalar()
    volume = (F.when(trend > 5.0, filled(rules.ACTIVITY_UP, trend=fixed_text(trend, 1)))
              .when(trend < -5.0, filled(rules.ACTIVITY_DOWN, trend=fixed_text(F.abs(trend), 1)))
              .otherwise(rules.ACTIVITY_STABLE))
    anomalous = F.when(rate > 15.0, filled(rules.ACTIVITY_ANOMALOUS, rate=fixed_text(rate, 1))).otherwise(rules.ACTIVITY_SOUND)
    problems = F.when(F.col("total_events") > 0, anomalous)
    return kpis.select(F.array_compact(F.array(volume, problems, leader, F.lit(rules.ACTIVITY_NORMAL))).alias("insights"))


def pipeline_health(stats):
    """Health from throughput: takes ``ingested``, ``invocations``, ``errors`` (per minute) and ``raw_records``."""
    rate = percent_of(F.col("errors"), F.col("invocations"))
    stalled = (F.col("ingested") == 0) & (F.col("invocations") == 0) & (F.col("raw_records") > 0)
    found = F.array_compact(F.array(
        F.when(stalled, rules.PIPELINE_STALLED), F.when(rate > 2.0, filled(rules.PIPELINE_ERRORS, rate=fixed_text(rate, 1)))))
    return stats.select(
        "*", rate.alias("error_rate_pct"),
        F.when(rate > 10.0, "critical").when((rate > 2.0) | stalled, "warning").otherwise("healthy").alias("pipeline_health"),
        F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(rules.PIPELINE_NORMAL))).alias("health_reasons"))
