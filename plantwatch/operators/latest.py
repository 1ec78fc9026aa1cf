"""Newest rows: per machine, per fleet, and top-k histories."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from plantwatch import rules
from plantwatch.functions import sensors
from plantwatch.functions.numbers import exact_round
from plantwatch.functions.text import filled
from plantwatch.rules import GAUGES

RECENCY = ("timestamp", "event_id")


def newest(columns):
    """Aggregate: the given columns of the newest row. Combines before the shuffle, one row per key and task."""
    return F.max_by(F.struct(*columns), F.struct(*RECENCY))


def latest_per_machine(df, columns=None):
    """The newest row of each machine; equal seconds are decided by the larger event id.

    Name the ``columns`` you need: the others are then not read.
    """
    names = [c for c in (columns or df.columns) if c != "machine_id"]
    picked = df.groupBy("machine_id").agg(newest(names).alias("r"))
    return picked.select("machine_id", "r.*")


def _newest_first():
    return Window.partitionBy("machine_id").orderBy(*[F.desc(c) for c in RECENCY])


def top_per_machine(df, n):
    """The newest n rows of each machine, ``rank`` 1 first; tasks drop the rest before the shuffle."""
    return df.withColumn("rank", F.row_number().over(_newest_first())).filter(F.col("rank") <= n)


def alerts(df, limit=50):
    """Newest anomalous events of the fleet, with texts for the missing parts."""
    return (df.filter("anomaly_detected")
            .select("event_id", "machine_id", "machine_type", "timestamp",
                    F.coalesce(F.nullif(F.col("anomaly_type"), F.lit("")), F.lit("unknown")).alias("anomaly_type"),
                    F.coalesce("anomaly_severity", F.lit(0.0)).alias("severity"),
                    F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("anomaly")).alias("status"))
            .orderBy(F.desc("timestamp"), F.desc("event_id")).limit(limit))


def alert_details(alert_rows):
    """Alerts with severity band, explanation and action."""
    return alert_rows.withColumns({
        "severity_label": sensors.severity_band(F.col("severity")),
        "explanation": sensors.alert_explanation(),
        "action": sensors.alert_action()})


def _timeline_type(severity):
    return F.when(severity >= 0.8, "critical").when(severity >= 0.4, "warning").otherwise("anomaly")


def risk_timeline(df, machines, n=10):
    """Last n anomalies of each machine; a machine without any that is not healthy gets one row for its state.

    ``machines`` has machine_id, health_status, anomaly_events and timestamp, one row per machine.
    """
    severity = F.coalesce("anomaly_severity", F.lit(0.5))
    kind = F.coalesce(F.nullif(F.col("anomaly_type"), F.lit("")), F.lit("anomaly"))
    reason = F.nullif(F.col("anomaly_reason"), F.lit(""))
    events = top_per_machine(
        df.filter("anomaly_detected").select("machine_id", *RECENCY, "anomaly_type", "anomaly_severity", "anomaly_reason"), n)
    events = events.select(
        "machine_id", "rank", "timestamp", _timeline_type(severity).alias("event_type"),
        F.coalesce(reason, filled(rules.TIMELINE_EVENT, kind=kind)).alias("description"),
        severity.alias("severity"))
    quiet = machines.filter("health_status <> 'healthy' AND anomaly_events = 0")
    state = quiet.select(
        "machine_id", F.lit(1).alias("rank"), "timestamp", F.col("health_status").alias("event_type"),
        filled(rules.TIMELINE_STATE, state=F.col("health_status")).alias("description"),
        F.when(F.col("health_status") == "warning", 0.5).otherwise(0.8).alias("severity"))
    return events.unionByName(state)


HISTORY_COLUMNS = ["temperature", "degradation_level", "anomaly_detected", "status", "pressure", "power_consumption",
                   "vibration", "cycle_efficiency"]


def recent_history(df, n=20):
    """Last n readings of each machine."""
    return top_per_machine(df.select("machine_id", *RECENCY, *HISTORY_COLUMNS), n).select(
        "machine_id", "rank", "timestamp", *HISTORY_COLUMNS)


def current_conditions(df):
    """Latest five readings of each machine."""
    latest = latest_per_machine(df, ["temperature", "pressure", "power_consumption", "vibration", "degradation_level"])
    return latest.select("machine_id", "temperature", "pressure", "power_consumption", "vibration",
                         F.coalesce("degradation_level", F.lit(0.0)).alias("degradation"))


def sensor_bands(df):
    """Gauge status of the latest five readings: one row per machine and gauge."""
    latest = latest_per_machine(df, [g["column"] for g in GAUGES.values()])
    cells = [F.struct(F.lit(name).alias("metric"), F.col(g["column"]).alias("value"),
                      sensors.gauge_band(F.col(g["column"]), g).alias("band")) for name, g in GAUGES.items()]
    return latest.select("machine_id", F.inline(F.array(*cells)))


def fleet_snapshot(df):
    """Fleet state over the latest row of each machine."""
    energy = ["power_consumption", "energy_usage", "energy_output"]
    latest = latest_per_machine(df, ["temperature", "motor_temperature", "anomaly_detected", "status", *energy])
    status = lambda name: F.count_if(F.col("status") == name)
    total = F.lit(0.0)
    for name in energy:
        total = total + F.coalesce(name, F.lit(0.0))
    counts = latest.agg(
        F.count("*").alias("total_machines"),
        F.avg(F.coalesce("temperature", "motor_temperature")).alias("temperature"),
        F.count_if(F.col("anomaly_detected")).alias("active_anomalies"),
        *[status(s).alias(f"{s}_machines") for s in ("healthy", "warning", "critical", "offline")],
        F.sum(total).alias("energy"))
    active = F.col("total_machines") - F.col("offline_machines")
    return counts.select(
        "total_machines", exact_round(F.coalesce("temperature", F.lit(0.0)), 2).alias("avg_temperature"),
        "active_anomalies", "healthy_machines", "warning_machines", "critical_machines", "offline_machines",
        exact_round(F.coalesce("energy", F.lit(0.0)), 2).alias("total_energy_consumption"),
        exact_round(F.when(active > 0, F.col("healthy_machines") / active * 100.0).otherwise(0.0), 2)
        .alias("operational_efficiency_pct"))
