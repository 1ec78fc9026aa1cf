"""Failures that show up on dependent machines, on streams: spans of disturbance first, then a join of two streams.

One query turns failures into spans (per machine, in a state store) and writes, for each of its batches, how much each rule
disturbs each second. A second query joins the events of dependent machines with these seconds. Both sides of the join have
a watermark, and markers tell the second query how far the first has come, so its state stays bounded without failures too.
"""

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from plantwatch.functions.times import event_time
from plantwatch.operators.correlate import dependants_of, disturbed_seconds, failing
from plantwatch.rules import EXPOSURES
from plantwatch.sources.lake import batch_path, is_written
from plantwatch.streaming.presence import keep_state_in_rocksdb

SPANS = "rule string, machine_id string, opened long, closed long, severity double"
SECONDS = "rule string, second long, source_machines long, severity_sum double, max_severity double"
HELD = "at long, severity double, timer long"


def stream_disturbances(rows, seconds_path, checkpoint, distance=3600, delay="10 minutes", part=60, exposures=None, trigger=None):
    """Write the disturbed seconds of a stream of telemetry rows; returns the started query.

    A batch writes to a folder by its id, once: a folder that is whole stays as it is when the batch runs again. Failures are
    gathered per machine and slice of ``part`` seconds before they meet the machine's state, which is its latest failure.
    """
    keep_state_in_rocksdb(rows.sparkSession)
    exposures = exposures or EXPOSURES
    timed = rows.withColumn("event_time", event_time()).withWatermark("event_time", delay)
    rule, severity = failing()
    origins = F.col("machine_type").isin([source for _, source, _, _ in exposures])
    timed = timed.select("event_time", "machine_id", F.when(origins, rule).alias("rule"), severity)
    # all rows count for the markers, which have no rule and no machine
    named = F.col("rule").isNotNull()
    timed = timed.select("event_time", F.coalesce("rule", F.lit("")).alias("rule"), F.when(named, F.col("machine_id")).alias("machine_id"),
                         F.when(named, F.struct(F.unix_timestamp("event_time").alias("at"), F.coalesce("severity", F.lit(0.0)).alias("severity"))).alias("failure"))
    slices = timed.groupBy(F.window("event_time", f"{part} seconds"), "rule", "machine_id").agg(
        F.collect_list("failure").alias("failures"), F.max(F.unix_timestamp("event_time")).alias("newest"))
    slices = slices.select("rule", "machine_id", F.window_time("window").alias("slice_time"), "failures", "newest")
    spans = slices.groupBy("rule", "machine_id").transformWithState(_spans(int(distance), int(part)), SPANS, "Append", "eventTime")

    def write(batch, batch_id):
        path = batch_path(seconds_path, batch_id)
        if is_written(batch.sparkSession, path):
            return
        batch = batch.persist()
        try:
            seconds = disturbed_seconds(batch.filter("rule <> ''"), distance)
            markers = batch.filter("rule = ''").groupBy("rule").agg(F.max("opened").alias("second"))
            none = markers.select("rule", "second", F.lit(0).cast("long"), F.lit(0.0), F.lit(0.0))
            seconds.select("rule", "second", F.col("source_machines").cast("long"), "severity_sum", "max_severity").union(none).write.mode("overwrite").parquet(path)
        finally:
            batch.unpersist()

    return spans.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


def stream_correlated(rows, seconds_path, distance=3600, delay="10 minutes", part=60, exposures=None, bucket="1 hour"):
    """The rows of ``correlated_within`` as a stream, for buckets that are closed, from events and disturbed seconds.

    ``distance`` and ``part`` are those of ``stream_disturbances``. A second is closed when no span that is still open there can
    reach it. Events wait for the seconds they lie in, so the state holds about ``distance`` seconds of events, counted
    per machine and second.
    """
    exposures, spark = exposures or EXPOSURES, rows.sparkSession
    seconds = spark.readStream.schema(SECONDS).parquet(seconds_path).withColumn("at", F.timestamp_seconds("second"))
    seconds = seconds.withWatermark("at", f"{distance + 2 * part} seconds").groupBy("rule", "at").agg(
        *[f(c).alias(c) for f, c in ((F.sum, "source_machines"), (F.sum, "severity_sum"), (F.max, "max_severity"))])
    seconds = seconds.select("*", F.explode(dependants_of(exposures)).alias("dependant"))
    dependants = sorted({d for _, _, types, _ in exposures for d in types})
    events = rows.filter(F.col("machine_type").isin(dependants)).withColumn("event_time", event_time()).withWatermark("event_time", delay)
    events = events.groupBy("machine_id", "machine_type", "event_time").agg(F.count("*").alias("events"))
    met = events.join(seconds, (F.col("machine_type") == F.col("dependant")) & (F.col("event_time") == F.col("at")))
    exposed = met.groupBy(F.window("event_time", bucket), "machine_id", "machine_type", "rule").agg(
        F.sum("events").alias("events"), *[F.max(c).alias(c) for c in ("source_machines", "severity_sum", "max_severity")])
    return exposed.select("machine_id", "machine_type", F.date_format("window.start", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("bucket_start"), "rule", "events",
                          "source_machines", "severity_sum", "max_severity")


def _spans(distance, slack):
    """The latest failure of one machine; a span ends with the next failure or, by a timer, after ``distance`` seconds.

    A class of this call, so that Spark sends it whole to workers without this package.
    """
    held_type, row = HELD, Row(*[part.split()[0] for part in SPANS.split(", ")])

    class Spans(StatefulProcessor):
        def init(self, handle):
            self.handle, self.held = handle, handle.getValueState("held", held_type)

        def handleInputRows(self, key, rows, timerValues):
            rule, machine = key[0], key[1]
            if rule == "":
                newest = max(part["newest"] for part in rows)
                yield row(rule, machine, newest, newest, 0.0)
                return
            worst = {}
            for part in rows:
                for failure in part["failures"]:
                    worst[failure["at"]] = max(failure["severity"], worst.get(failure["at"], failure["severity"]))
            at, severity, timer = self.held.get() if self.held.exists() else (None, None, None)
            for second in sorted(worst):
                if at is not None:
                    yield row(rule, machine, at, min(second, at + distance), severity)
                at, severity = second, worst[second]
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = (at + distance + slack) * 1000
            self.handle.registerTimer(timer)
            self.held.update((at, severity, timer))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            at, severity, _ = self.held.get()
            self.held.clear()
            yield row(key[0], key[1], at, at + distance, severity)

        def close(self):
            pass

    return Spans()
