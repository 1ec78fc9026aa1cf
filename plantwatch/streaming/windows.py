"""Event-time results over a stream of telemetry rows, on Spark's built-in windows and state."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from plantwatch.functions.times import event_time
from plantwatch.operators.aggregates import anomaly_count
from plantwatch.sources.lake import batch_path


def _timed(rows, delay):
    return rows.withColumn("event_time", event_time()).withWatermark("event_time", delay)


def tumbling_summary(rows, every="1 hour", delay="10 minutes"):
    """Factory summary per tumbling window; equal to the batch view for windows that are closed.

    Machines are aggregated first, so the exact number of active machines is a plain count in the second step and
    no window's rows meet in one task.
    """
    per_machine = _timed(rows, delay).groupBy(F.window("event_time", every), "machine_id").agg(
        F.count("*").alias("n"), anomaly_count().alias("a"), F.sum("degradation_level").alias("s"),
        F.count("degradation_level").alias("c"))
    summary = per_machine.groupBy(F.window(F.window_time("window"), every)).agg(
        F.sum("n").alias("total_events"), F.count("*").alias("active_machines"), F.sum("a").alias("total_anomalies"),
        (F.sum("s") / F.sum("c")).alias("avg_degradation_level"))
    length = F.unix_timestamp("window.end") - F.unix_timestamp("window.start")
    label = lambda pattern: F.date_format("window.start", pattern)
    return summary.select(
        F.when(length % 3600 == 0, label("yyyy-MM-dd'T'HH")).when(length % 60 == 0, label("yyyy-MM-dd'T'HH:mm"))
        .otherwise(label("yyyy-MM-dd'T'HH:mm:ss")).alias("time_bucket"),
        "total_events", "active_machines", "total_anomalies", "avg_degradation_level")


def sliding_activity(rows, length="1 hour", slide="15 minutes", delay="10 minutes"):
    """Event, anomaly and status counts per sliding window."""
    status = lambda *s: F.count_if(F.col("status").isin(*s))
    counts = _timed(rows, delay).groupBy(F.window("event_time", length, slide)).agg(
        F.count("*").alias("total_events"), anomaly_count().alias("anomaly_count"), status("healthy").alias("healthy_count"),
        status("warning").alias("warning_count"), status("critical", "anomaly").alias("critical_count"))
    return counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                         *[c for c in counts.columns if c != "window"])


def anomaly_sessions(rows, gap="6 hours", delay="10 minutes"):
    """Sessions of one anomaly type on one machine: events no further apart than the gap.

    With ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` on, as in ``session.local_session``, each
    task merges its sessions before the shuffle, so a machine with many anomalies sends few rows.
    """
    sessions = _timed(rows.filter("anomaly_detected"), delay).groupBy(
        F.session_window("event_time", gap).alias("s"), "machine_id", "anomaly_type").agg(
        F.count("*").alias("events"), F.min("event_time").alias("start_time"), F.max("event_time").alias("end_time"),
        F.max("anomaly_severity").alias("max_severity"))
    return sessions.select(
        "machine_id", "anomaly_type", "start_time", "end_time",
        (F.unix_timestamp("end_time") - F.unix_timestamp("start_time")).alias("duration_seconds"), "events", "max_severity")


def latest_state(rows):
    """Last known state per machine, kept by the stream (output mode ``update`` or ``complete``)."""
    newest = F.max_by(F.struct("timestamp", "event_id", "machine_type", "status", "anomaly_type", "degradation_level"),
                      F.struct("timestamp", "event_id"))
    return rows.groupBy("machine_id").agg(newest.alias("r"), F.count("*").alias("events")).select(
        "machine_id", "r.*", "events")


def status_changes(rows, changes_path, state_path, stats_path, checkpoint, trigger=None):
    """Status of each machine kept by the stream, with an event for each change and the time the old status lasted.

    ``changes_path`` gets the changes, ``state_path`` the state of all machines after a batch (status, since when, newest
    event), ``stats_path`` the events used and those passed over because they are not after the machine's newest one. Each
    batch owns a folder by its id and reads the state of the batch before, so one that runs again gives the same.
    """
    def write(batch, batch_id):
        spark = batch.sparkSession
        fresh = batch.select("machine_id", "timestamp", F.col("event_id").cast("string").alias("event_id"), "status",
                             F.lit(None).cast("string").alias("since"), F.lit(False).alias("kept"))
        if batch_id:
            held = spark.read.schema(STATE).parquet(batch_path(state_path, batch_id - 1))
            rows = fresh.unionByName(held.withColumn("kept", F.lit(True)))
        else:
            rows = fresh
        machine = Window.partitionBy("machine_id")
        newest = F.max(F.when(F.col("kept"), F.struct("timestamp", "event_id"))).over(machine)
        rows = rows.withColumn("old", ~F.col("kept") & F.coalesce(F.struct("timestamp", "event_id") <= newest, F.lit(False))).persist()
        try:
            history = machine.orderBy("timestamp", "event_id")
            used = rows.filter(~F.col("old")).withColumn("previous_status", F.lag("status").over(history))
            begins = F.lag("event_id").over(history).isNull() | ~F.col("status").eqNullSafe(F.col("previous_status"))
            used = used.withColumn("since", F.coalesce("since", F.when(begins, F.col("timestamp"))))
            used = used.withColumn("since", F.last("since", ignorenulls=True).over(history.rowsBetween(Window.unboundedPreceding, 0)))
            lasted = F.unix_timestamp(event_time()) - F.unix_timestamp(event_time(F.lag("since").over(history)))
            used = used.withColumn("seconds_in_previous", lasted)
            changed = ~F.col("kept") & F.col("previous_status").isNotNull() & ~F.col("status").eqNullSafe(F.col("previous_status"))
            used.filter(changed).select("machine_id", "timestamp", "event_id", "previous_status", "status", "seconds_in_previous"
                                        ).write.mode("overwrite").parquet(batch_path(changes_path, batch_id))
            state = used.groupBy("machine_id").agg(F.max_by(F.struct("timestamp", "event_id", "status", "since"), F.struct("timestamp", "event_id")).alias("r"))
            state.select("machine_id", "r.*").write.mode("overwrite").parquet(batch_path(state_path, batch_id))
            rows.filter(~F.col("kept")).agg(F.count_if(~F.col("old")).alias("events"), F.count_if("old").alias("passed_over")).write.mode(
                "overwrite").parquet(batch_path(stats_path, batch_id))
        finally:
            rows.unpersist()

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


STATE = "machine_id string, timestamp string, event_id string, status string, since string"
