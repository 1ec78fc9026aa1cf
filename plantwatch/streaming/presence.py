"""Status and presence of machines, kept by the stream in a state store with timers."""

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from plantwatch.functions.times import event_time

OFFLINE = "offline"
HELD = "status string, since long, seen long, timer long"
CHANGES = "machine_id string, at long, event_id string, previous_status string, status string, seconds_in_previous long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_MB = 200


def keep_state_in_rocksdb(spark, large=False):
    """State with timers needs this state store; queries that were started before keep theirs. A batch stores what it changed.

    State that is ``large``, as with a row per record, is put into files whole when a batch ends. So only the stores that tasks
    work on hold rows in memory, outside the heap, and all stores of an executor together ``STATE_MB``.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "false" if large else "true")
    if large:
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", STATE_MB)


def status_runs(rows, silence, delay, part):
    """Per machine and slice of time ``part`` the runs of one status without a silence: ``(at, event_id, status, until)``.

    A machine that sends a third of all events is spread over its slices here; what goes on to its state are runs.
    """
    timed = rows.withColumn("event_time", event_time()).withWatermark("event_time", delay)
    events = timed.select("machine_id", "event_time", F.unix_timestamp("event_time").alias("at"), F.col("event_id").cast("string").alias("event_id"), "status")
    slices = events.groupBy(F.window("event_time", part), "machine_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_id", "status"))).alias("e"))
    begins = f"""filter(sequence(0, size(e) - 1), i -> i = 0 OR NOT e[i].status <=> e[i - 1].status OR e[i].at - e[i - 1].at > {int(silence)})"""
    runs = """transform(b, (i, k) -> struct(e[i].at AS at, e[i].event_id AS event_id, e[i].status AS status,
              e[if(k + 1 < size(b), b[k + 1], size(e)) - 1].at AS until))"""
    return slices.withColumn("b", F.expr(begins)).select("machine_id", F.window_time("window").alias("slice_time"), F.expr(runs).alias("runs"))


def machine_presence(rows, silence=300, delay="10 minutes", part="1 minute", forget=None):
    """Changes of each machine's status, silence included: a machine without an event for ``silence`` seconds is offline.

    The change to offline happens ``silence`` seconds after the newest event, by a timer, so it needs no further event of that
    machine; its next event ends the state. A machine that has reported to be offline doesn't go offline again. A change
    has the old and the new status and how long the old one lasted; ``event_id`` is null where a silence made it. Events
    are taken in order of time and id; those later than the watermark are dropped and counted by Spark. With ``forget`` a
    machine's state is removed so many seconds after its newest event; if it comes back, it is new.

    The state is one row per machine in the state store, of which a batch touches only the machines that it concerns.
    The session is set to the state store that has timers.
    """
    keep_state_in_rocksdb(rows.sparkSession)
    # plain columns: Python reads them cell by cell, where a list of structs or a time costs several times as much
    runs = status_runs(rows, silence, delay, part).select("machine_id", F.inline("runs"))
    slack = rows.sparkSession.sql(f"SELECT unix_timestamp(timestamp'1970-01-01 00:00:00' + INTERVAL {part}) - unix_timestamp(timestamp'1970-01-01 00:00:00')").first()[0]
    changes = runs.groupBy("machine_id").transformWithState(_presence(int(silence), int(slack), forget), CHANGES, "Append", "eventTime")
    return changes.select("machine_id", F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "event_id", "previous_status",
                          "status", "seconds_in_previous")


def _presence(silence, slack, forget):
    """The state of one machine. A class of this call, so that Spark sends it whole to workers without this package.

    Timers wait ``slack`` seconds more, the length of a slice, because events come when their slice is closed. Each call of the
    state or a timer is a message to the JVM, so a machine gets a timer only if it can change something later.
    """
    offline, held_type, row = OFFLINE, HELD, Row(*[part.split()[0] for part in CHANGES.split(", ")])

    class Presence(StatefulProcessor):
        def init(self, handle):
            self.handle, self.held = handle, handle.getValueState("held", held_type)

        def handleInputRows(self, key, rows, timerValues):
            status, since, seen, timer = self.held.get() or (None, None, None, None)
            runs = ((at, event_id or "", event_id is not None, now is not None, now or "", event_id, now, until) for _, at, event_id, now, until in rows)
            for at, _, _, _, _, event_id, now, until in sorted(runs, key=lambda run: run[:5]):
                if seen is not None and at - seen > silence and status != offline:
                    yield row(key[0], seen + silence, None, status, offline, seen + silence - since)
                    status, since = offline, seen + silence
                if seen is not None and now != status:
                    yield row(key[0], at, event_id, status, now, at - since)
                if seen is None or now != status:
                    status, since = now, at
                seen = until
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = (seen + silence + slack) * 1000
            if forget is None and timer < timerValues.getCurrentWatermarkInMs():  # it would expire in this batch
                timer = None
                if status != offline:
                    yield row(key[0], seen + silence, None, status, offline, seen + silence - since)
                    status, since = offline, seen + silence
            elif forget is None and status == offline:
                timer = None
            if timer is not None:
                self.handle.registerTimer(timer)
            self.held.update((status, since, seen, timer))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            status, since, seen, timer = self.held.get()
            if forget is not None and expiredTimerInfo.getExpiryTimeInMs() >= (seen + max(forget, silence) + slack) * 1000:
                self.held.clear()
                return
            timer = None
            if forget is not None:
                timer = (seen + max(forget, silence + 1) + slack) * 1000
                self.handle.registerTimer(timer)
            if status != offline:
                yield row(key[0], seen + silence, None, status, offline, seen + silence - since)
                status, since = offline, seen + silence
            self.held.update((status, since, seen, timer))

        def close(self):
            pass

    return Presence()
