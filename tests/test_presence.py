import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from plantwatch.checks import queries
from plantwatch.operators.correlate import correlated_within
from plantwatch.session import work_dir
from plantwatch.streaming import correlate, ingest, presence

EVENTS = "machine_id string, timestamp string, event_id string, status string"


def text(second):
    return f"2024-01-01T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}Z"


def changes(spark, *parts, **options):
    """Changes after each part of (machine, second, status) events, by one stream that is stopped in between."""
    base, found, number = work_dir(spark, "presence"), [], 0
    for part in parts:
        rows = []
        for machine, second, status in part:
            rows.append((machine, text(second), f"{number:04d}", status))
            number += 1
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(EVENTS).parquet(f"{base}/in")
        made = presence.machine_presence(stream, **{"silence": 300, "delay": "0 seconds", **options})
        ingest.records_writer(made, f"{base}/checkpoint").format("parquet").option("path", f"{base}/out").start().awaitTermination()
        found.append(sorted(tuple(r) for r in spark.read.schema(made.schema).parquet(f"{base}/out").collect()))
    return found


def test_a_silent_machine_goes_offline_without_an_event_of_its_own(spark):
    others = lambda *seconds: [("B", s, "healthy") for s in seconds]
    first, second, third = changes(spark, [("A", 10, "healthy"), ("A", 70, "warning"), *others(20, 130, 300, 360)], others(500, 700, 900),
                                   [("A", 1000, "warning"), *others(1100, 1300)])
    assert first == [("A", text(70), "0001", "healthy", "warning", 60)]
    assert second == [*first, ("A", text(370), None, "warning", "offline", 300)]
    assert third == [*second, ("A", text(1000), "0009", "offline", "warning", 630)]


def test_the_result_does_not_depend_on_batches(spark):
    events = [("A", 0, "healthy"), ("A", 300, "healthy"), ("A", 601, "healthy"), ("A", 602, "offline"), ("A", 2000, "offline"), ("A", 2001, "critical"),
              ("A", 2001, "healthy"), ("B", 0, "warning"), ("B", 59, "healthy"), ("B", 61, "warning"), ("C", 9000, "healthy")]
    whole = changes(spark, events)[-1]
    assert whole == [("A", text(600), None, "healthy", "offline", 600), ("A", text(601), "0002", "offline", "healthy", 1), ("A", text(602), "0003", "healthy", "offline", 1),
                     ("A", text(2001), "0005", "offline", "critical", 1399), ("A", text(2001), "0006", "critical", "healthy", 0), ("A", text(2301), None, "healthy", "offline", 300),
                     ("B", text(59), "0008", "warning", "healthy", 59), ("B", text(61), "0009", "healthy", "warning", 2), ("B", text(361), None, "warning", "offline", 300)]
    parts = [[e for e in events if low <= e[1] < high] for low, high in ((0, 301), (301, 1999), (1999, 99999))]
    ordered = changes(spark, *parts)[-1]
    assert [r[:2] + r[3:] for r in ordered] == [r[:2] + r[3:] for r in whole]


def test_a_forgotten_machine_is_new(spark):
    other = [("B", s, "healthy") for s in (10_000, 10_200)]
    events = [("A", 0, "healthy")], other, [("A", 10_400, "warning"), ("B", 10_600, "healthy"), ("B", 10_700, "healthy")]
    kept = [r for r in changes(spark, *events)[-1] if r[0] == "A"]
    assert [r[3:5] for r in kept] == [("healthy", "offline"), ("offline", "warning")]
    assert [r[3:5] for r in changes(spark, *events, forget=3600)[-1] if r[0] == "A"] == [("healthy", "offline")]


def test_a_timer_is_kept_only_where_it_can_change_something(spark):
    """A is offline, B falls silent within the run, C may still fall silent: one timer, and none runs out."""
    rows = [("A", text(0), "0", "offline"), ("B", text(10), "1", "healthy"), *[("C", text(s), str(s), "healthy") for s in range(200, 2000, 200)]]
    base = work_dir(spark, "timers")
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{base}/in")
    made = presence.machine_presence(spark.readStream.schema(EVENTS).parquet(f"{base}/in"), delay="0 seconds")
    query = ingest.records_writer(made, f"{base}/checkpoint").format("parquet").option("path", f"{base}/out").start()
    query.awaitTermination()
    custom = [s["customMetrics"] for p in query.recentProgress for s in p["stateOperators"] if "numRegisteredTimers" in s["customMetrics"]]
    assert [sum(c[n] for c in custom) for n in ("numRegisteredTimers", "numExpiredTimers")] == [1, 0]
    assert sorted(tuple(r)[:2] for r in spark.read.schema(made.schema).parquet(f"{base}/out").collect()) == [("B", text(310))]


def test_the_rows_of_two_runs_are_written_by_many_tasks(spark):
    runs = []
    base = queries._in_two_runs(spark, spark.range(0, 1000, 1, 4), F.col("id") % 2 == 0, lambda stream, base: SimpleNamespace(
        awaitTermination=lambda: runs.append(len(spark.read.parquet(f"{base}/source").inputFiles()))))
    assert runs == [4, 8] and spark.read.parquet(f"{base}/source").count() == 1000


def test_state_is_small_for_a_machine_with_most_events(spark):
    rows = spark.range(20_000).select(F.lit("A").alias("machine_id"), F.date_format(F.timestamp_seconds(F.col("id") / 10), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
                                      F.col("id").cast("string").alias("event_id"), F.lit("healthy").alias("status"))
    base = work_dir(spark, "hot")
    rows.write.parquet(f"{base}/in")
    runs = presence.status_runs(spark.readStream.schema(EVENTS).parquet(f"{base}/in"), 300, "0 seconds", "1 minute")
    ingest.records_writer(runs, f"{base}/checkpoint").format("parquet").option("path", f"{base}/out").start().awaitTermination()
    found = spark.read.parquet(f"{base}/out")
    assert found.count() == 33 and found.agg(F.max(F.size("runs"))).first()[0] == 1


def test_correlated_stream_equals_the_batch_and_keeps_little(spark):
    """Three runs of one stream; every closed hour is exact and the state doesn't grow with the runs."""
    dice = random.Random(5)
    rows = []
    for second in sorted(dice.randrange(0, 86_000) for _ in range(1_500)):
        kind, machine = dice.choice([("cooling_system", f"C{dice.randrange(3)}"), ("cnc_machine", f"N{dice.randrange(3)}"), ("robotic_arm", f"A{dice.randrange(2)}")])
        rows.append((f"{len(rows):05d}", machine, kind, text(second), dice.random() < 0.3, dice.randrange(8) / 8, dice.randrange(8) / 16, None))
    schema = "event_id string, machine_id string, machine_type string, timestamp string, anomaly_detected boolean, anomaly_severity double, degradation_level double, anomaly_type string"
    table, base, kept = spark.createDataFrame(rows, schema), work_dir(spark, "correlated"), []
    for k in range(3):
        spark.createDataFrame(rows[k * 500:(k + 1) * 500], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        correlate.stream_disturbances(stream, f"{base}/seconds", f"{base}/a", distance=1800, delay="1 second").awaitTermination()
        exposed = correlate.stream_correlated(stream, f"{base}/seconds", distance=1800, delay="1 second")
        query = ingest.records_writer(exposed, f"{base}/b").format("parquet").option("path", f"{base}/out").start()
        query.awaitTermination()
        kept.append(sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]))
    found = sorted(tuple(r) for r in spark.read.parquet(f"{base}/out").collect())
    batch = correlated_within(table, distance=1800).withColumn("time_bucket", F.concat("time_bucket", F.lit(":00:00Z")))
    want = sorted(tuple(r) for r in batch.select("machine_id", "machine_type", "time_bucket", "rule", "events", "source_machines", "severity_sum", "max_severity").collect()
                  if r["time_bucket"] < "2024-01-01T23")
    assert len(found) > 100 and found == want
    assert max(kept) < 12_000 and kept[-1] < 2 * kept[0]
