"""Machine health table and the per-machine documents built from it."""

from datetime import timedelta

from pyspark.sql import functions as F

from plantwatch import rules
from plantwatch.functions import sensors
from plantwatch.functions.stages import staged
from plantwatch.functions.times import bound_column, bound_text, bucket_label, event_time, parse_text, time_range
from plantwatch.operators import diagnose as dx
from plantwatch.operators.aggregates import anomaly_count
from plantwatch.operators.latest import newest, recent_history, risk_timeline
from plantwatch.session import stored

_SCORED = ["temperature", "motor_temperature", "vibration", "power_consumption", "energy_usage", "energy_output",
           "pressure", "hydraulic_pressure", "cycle_efficiency", "task_completion_rate", "degradation_level"]


def _newest_with_totals(df, columns):
    """Newest row and event totals of each machine from one scan and one shuffle."""
    both = df.groupBy("machine_id").agg(
        F.count("*").alias("total_events"), anomaly_count().alias("anomaly_events"),
        F.avg("temperature").alias("mean_temperature"), F.max("degradation_level").alias("peak_degradation"),
        newest(columns).alias("r"))
    return both.select("machine_id", "total_events", "anomaly_events", "mean_temperature", "peak_degradation", "r.*")


def machines(df):
    """One row per machine: totals, latest temperature and degradation, health score and status.

    ``avg_temperature`` and ``max_degradation_level`` hold the latest readings, as their consumers expect;
    ``latest_temperature`` and ``latest_degradation`` say so.
    """
    rows = _newest_with_totals(df, ["machine_type", *_SCORED])
    scored = staged(rows, health_score=sensors.health_score())
    return scored.select(
        "machine_id", F.coalesce("machine_type", F.lit("unknown")).alias("machine_type"), "total_events",
        "anomaly_events", (F.col("anomaly_events").cast("double") / F.col("total_events") * 100.0).alias("anomaly_rate_percent"),
        F.col("temperature").alias("avg_temperature"),
        F.coalesce("degradation_level", F.lit(0.0)).alias("max_degradation_level"),
        sensors.health_status(F.col("health_score")).alias("health_status"), "health_score",
        F.col("temperature").alias("latest_temperature"), F.col("degradation_level").alias("latest_degradation"))


def factory_summary(machine_rows):
    """Machines by health status; the score never yields offline, so that count is 0."""
    count = lambda s: F.count_if(F.col("health_status") == s).alias(s)
    return machine_rows.agg(F.count("*").alias("total_machines"), *[count(s) for s in rules.STATUSES])


def fleet_filter_sort(machine_rows, search="", status="all", machine_type="all", sort_by="id"):
    """Registry listing: substring search, two filters and five orders."""
    rows = machine_rows.filter(F.lower("machine_id").contains(search.lower()))
    if status != "all":
        rows = rows.filter(F.col("health_status") == status)
    if machine_type != "all":
        rows = rows.filter(F.col("machine_type") == machine_type)
    state = F.col("health_status")
    orders = {
        "health": F.when(state == "critical", 1).when(state == "warning", 2).when(state == "healthy", 3).otherwise(4),
        "anomalies": F.desc("anomaly_events"),
        "temp": F.coalesce("avg_temperature", F.lit(0.0)).desc(),
        "activity": F.desc("total_events"),
    }
    first = [orders[sort_by]] if sort_by in orders else []
    return rows.orderBy(*first, "machine_id")


def predictive_maintenance(health_rows):
    """Risk, remaining life and advice from the greatest degradation of each machine."""
    return health_rows.select("machine_id", *sensors.maintenance(F.col("max_degradation_level")))


DAY = ("year", "month", "day")
_TRENDS = ["temperature", "pressure", "power_consumption", "vibration", "degradation_level", "cycle_efficiency"]


def machine_history(df, window="24h", machine_id=None, ends=None):
    """Bucketed means of each machine over the window that ends at its own newest event (unknown window: 24h).

    For one machine the window becomes literal bounds, which skip partitions. For the fleet the newest event of each
    machine is joined to its rows: machines that were active within the window of the newest event of all have theirs in
    two windows' time, again literal bounds; for machines that stopped earlier only the days of their own windows are read,
    where the table has the date columns. ``ends`` (machine and ``newest`` event text), from a machine table or a zone map
    (``partials.newest_events``), saves the scan for the newest events.
    """
    window = window if window in rules.WINDOWS else "24h"
    seconds, width, _ = rules.WINDOWS[window]
    columns = ["machine_id", "timestamp", *_TRENDS, "anomaly_detected"]
    if machine_id is not None:
        rows = df.filter(F.col("machine_id") == machine_id)
        end = parse_text(rows.agg(F.max("timestamp")).first()[0])
        rows = rows.limit(0).select(*columns) if end is None else time_range(
            rows, end - timedelta(seconds=seconds), end).select(*columns)
    else:
        length = timedelta(seconds=seconds)
        if ends is None:
            ends = df.groupBy("machine_id").agg(F.max("timestamp").alias("newest"))
        ends = stored(ends.select("machine_id", "newest"), "newest-events")
        last = parse_text(ends.agg(F.max("newest")).first()[0])
        if last is None:
            rows = df.limit(0).select(*columns)
        else:
            active = F.col("newest") >= bound_text(last - length)
            rows = _in_own_window(time_range(df, last - 2 * length, last).select(*columns), ends.filter(active), seconds)
            stopped = ends.filter(~active)
            if not stopped.isEmpty():
                days = _on_days(df, stopped, seconds)
                rows = rows.unionByName(_in_own_window(days.select(*columns), stopped, seconds))
    means = rows.groupBy("machine_id", F.substring("timestamp", 1, width).alias("time_bucket")).agg(
        *[F.avg(c).alias(c) for c in _TRENDS], anomaly_count().alias("anomaly_count"))
    return means.select(
        "machine_id", "time_bucket", bucket_label(F.col("time_bucket"), window).alias("label"), "temperature",
        F.coalesce("degradation_level", F.lit(0.0)).alias("degradation_level"),
        (F.col("anomaly_count") > 0).alias("anomaly_detected"),
        F.when(F.col("anomaly_count") > 0, "anomaly").otherwise("healthy").alias("status"),
        "pressure", "power_consumption", "vibration", "cycle_efficiency")


def _on_days(df, ends, seconds):
    """The rows of the days that the windows of these machines touch; the days are at most those of the table."""
    if not set(DAY) <= set(df.columns):
        return df
    end = event_time(F.col("newest"))
    days = F.sequence(F.to_date(end - F.make_dt_interval(secs=F.lit(seconds))), F.to_date(end))
    by_month = {}
    for (day,) in ends.filter(end.isNotNull()).select(F.explode(days)).distinct().collect():
        by_month.setdefault((day.year, day.month), []).append(day.day)
    wanted = F.lit(False)
    for (year, month), days_of in sorted(by_month.items()):
        wanted = wanted | ((F.col("year") == year) & (F.col("month") == month) & F.col("day").isin(sorted(days_of)))
    return df.filter(wanted)


def _in_own_window(rows, ends, seconds):
    """Rows in the window that ends at their own machine's newest event."""
    end = event_time(F.col("newest"))
    ends = ends.select("machine_id", bound_column(end - F.make_dt_interval(secs=F.lit(seconds))).alias("from"),
                       bound_column(end).alias("to"))
    return rows.join(ends, "machine_id").filter(
        (F.col("timestamp") >= F.col("from")) & (F.col("timestamp") <= F.col("to"))).drop("from", "to")


def history_or_recent(df, window="24h", n=20, machine_id=None, ends=None):
    """Bucketed history; machines whose window is empty get their last n readings instead.

    ``ends`` is as in ``machine_history``. Only if there are such machines is the table read for their readings.
    """
    history = stored(machine_history(df, window, machine_id, ends), "history")
    chosen = df if machine_id is None else df.filter(F.col("machine_id") == machine_id)
    listed = (chosen if ends is None else ends).select("machine_id").distinct()
    empty = stored(listed.join(history.select("machine_id"), "machine_id", "left_anti"), "without-history")
    readings = ["temperature", "degradation_level", "anomaly_detected", "status", "pressure", "power_consumption",
                "vibration", "cycle_efficiency"]
    rows = history.select("machine_id", F.col("label").alias("timestamp"), F.col("time_bucket").alias("sort_key"), *readings)
    if empty.isEmpty():
        return rows
    rest = recent_history(chosen.join(empty, "machine_id", "left_semi"), n)
    return rows.unionByName(rest.select("machine_id", "timestamp", F.col("timestamp").alias("sort_key"), *readings))


def machine_analytics(df, window="24h", machine_id=None):
    """One nested document per machine: totals, score, conditions, maintenance, active anomaly, causes, history, timeline.

    Takes rows with the diagnostic columns. All nested lists are bounded: a window has at most 61 buckets, the
    fallback 20 rows, the timeline 10, the causes a handful.
    """
    if machine_id is not None:
        df = df.filter(F.col("machine_id") == machine_id)
    columns = ["timestamp", "machine_type", "anomaly_detected", "anomaly_type", "anomaly_severity",
               "root_cause_candidates", "recommended_actions", "diagnostic_confidence", *_SCORED]
    base = staged(_newest_with_totals(df, columns), health_score=sensors.health_score())
    base = stored(base.withColumn("health_status", sensors.health_status(F.col("health_score"))), "machine-base")
    troubled = F.coalesce(F.col("anomaly_detected"), F.lit(False)) | (F.col("health_status") != "healthy")
    document = base.select(
        "machine_id", "machine_type", "total_events", "anomaly_events",
        (F.col("anomaly_events").cast("double") / F.col("total_events") * 100.0).alias("anomaly_rate_percent"),
        F.col("mean_temperature").alias("avg_temperature"),
        F.coalesce("peak_degradation", F.lit(0.0)).alias("max_degradation_level"), "health_status", "health_score",
        F.col("timestamp").alias("last_updated"),
        F.struct("temperature", "pressure", "power_consumption", "vibration",
                 F.coalesce("degradation_level", F.lit(0.0)).alias("degradation")).alias("current_conditions"),
        F.struct(*sensors.maintenance(F.col("peak_degradation"))).alias("predictive_maintenance"),
        F.when(troubled, dx.active_anomaly_struct()).alias("active_anomaly"),
        dx.cause_ranking().alias("root_cause_analysis"))
    history = _nested(history_or_recent(df, window, ends=base.select("machine_id", F.col("timestamp").alias("newest"))), "history", "sort_key")
    timeline = _nested(risk_timeline(df, base), "risk_timeline", "rank")
    return document.join(history, "machine_id", "left").join(timeline, "machine_id", "left")


def _nested(rows, name, order):
    fields = [c for c in rows.columns if c not in ("machine_id", order)]
    return rows.groupBy("machine_id").agg(
        F.array_sort(F.collect_list(F.struct(order, *fields))).alias(name))

