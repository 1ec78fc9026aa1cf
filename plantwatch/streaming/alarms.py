"""The documented alarms on streams: a window aggregate, then the run length of breaches in a state store."""

import math

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from plantwatch.rules import ALARMS
from plantwatch.streaming.presence import keep_state_in_rocksdb

HELD = "period long, sum double, max double, run long, on boolean, timer long"
CHANGES = "metric string, at long, state string, periods long"


def stream_alarm_changes(metrics, presets=ALARMS, delay="10 seconds"):
    """The rows of ``operators.alarms.alarm_changes`` as a stream of ``(metric, at, value)`` rows.

    Values are summed up in windows of the longest time that divides all periods, so a metric's state meets few rows however
    many values there are. A period without values ends by a timer: an alarm goes off without further input of its metric.
    """
    keep_state_in_rocksdb(metrics.sparkSession)
    step = math.gcd(*[p[3] for p in presets])
    windows = metrics.filter(F.col("metric").isin([p[0] for p in presets])).withWatermark("at", delay).groupBy(F.window("at", f"{step} seconds"), "metric").agg(
        F.sum(F.col("value").cast("double")).alias("sum"), F.max(F.col("value").cast("double")).alias("max"))
    parts = windows.select("metric", F.window_time("window").alias("part_time"), F.unix_timestamp("window.start").alias("start"), "sum", "max")
    changes = parts.groupBy("metric").transformWithState(_runs({p[0]: p[1:] for p in presets}), CHANGES, "Append", "eventTime")
    return changes.select("metric", F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("changed_at"), "state", "periods")


def _runs(presets):
    """The open period of one metric and its breaches in a row. A class of this call, so that Spark sends it whole to workers."""
    held_type, row = HELD, Row(*[part.split()[0] for part in CHANGES.split(", ")])

    class Runs(StatefulProcessor):
        def init(self, handle):
            self.handle, self.held = handle, handle.getValueState("held", held_type)

        def closed(self, metric, period, total, most, run, on):
            """The run, whether the alarm is on, and the change, if any, at the end of a period."""
            statistic, threshold, seconds, least = presets[metric]
            value = total if statistic == "sum" else most
            if value is None or value <= threshold:
                return 0, False, [row(metric, (period + 1) * seconds, "ok", run)] if on else []
            run += 1
            return run, on or run == least, [row(metric, (period + 1) * seconds, "alarm", run)] if run == least else []

        def kept(self, metric, old, period, total, most, run, on):
            """Store the state; a timer ends its period. Without a run an empty period needs none."""
            if old is not None:
                self.handle.deleteTimer(old)
            if total is None and most is None and not run:
                self.held.clear()
                return
            timer = (period + 1) * presets[metric][2] * 1000
            self.handle.registerTimer(timer)
            self.held.update((period, total, most, run, on, timer))

        def handleInputRows(self, key, rows, timerValues):
            metric, seconds = key[0], presets[key[0]][2]
            period, total, most, run, on, old = self.held.get() if self.held.exists() else (None, None, None, 0, False, None)
            for part in sorted(rows, key=lambda r: r["start"]):
                now = part["start"] // seconds
                while period is not None and period < now:
                    run, on, changes = self.closed(metric, period, total, most, run, on)
                    yield from changes
                    total = most = None
                    period = period + 1 if run else now  # empty periods matter only after breaches
                period = now
                if part["sum"] is not None:
                    total, most = (total or 0.0) + part["sum"], max(part["max"], part["max"] if most is None else most)
            self.kept(metric, old, period, total, most, run, on)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            period, total, most, run, on, _ = self.held.get()
            while True:
                run, on, changes = self.closed(key[0], period, total, most, run, on)
                yield from changes
                period, total, most = period + 1, None, None
                # a timer set here would wait for the next batch, so periods that are over end now
                if not run or (period + 1) * presets[key[0]][2] * 1000 > timerValues.getCurrentWatermarkInMs():
                    break
            self.kept(key[0], None, period, None, None, run, on)

        def close(self):
            pass

    return Runs()
