import json

from pyspark import StorageLevel
from pyspark.sql import functions as F

from plantwatch.operators.validate import validate_route
from plantwatch.session import work_dir
from plantwatch.sources import fixture, lake
from plantwatch.streaming import ingest
from plantwatch.schema import STREAM_RECORD


def run(spark, base, source, **options):
    records = spark.readStream.schema(STREAM_RECORD).parquet(source)
    ingest.stream_validate(records, f"{base}/raw", f"{base}/quarantine", f"{base}/stats", f"{base}/checkpoint",
                           ingest_time="2024-02-01 00:00:00", **options).awaitTermination()


def test_validate_then_curate_incrementally(spark, telemetry):
    base, source = work_dir(spark, "stream"), work_dir(spark, "source")
    records = fixture.stream_records(telemetry)
    number = F.col("seq").cast("int")
    for part in (number < 300, number >= 300):
        records.filter(part).coalesce(1).write.mode("append").parquet(source)
        run(spark, base, source)
        ingest.stream_curate(spark, f"{base}/raw", f"{base}/curated", f"{base}/curate").awaitTermination()
    curated = lake.curated_table(spark, f"{base}/curated")
    assert curated.count() == curated.select("event_id").distinct().count() == 750
    assert curated.filter("anomaly_detected AND anomaly_reason IS NULL").count() == 0
    assert spark.read.parquet(f"{base}/stats").agg(F.sum("total")).first()[0] == 1000


def test_sinks(spark, telemetry):
    base, source = work_dir(spark, "stream"), work_dir(spark, "source")
    fixture.stream_records(telemetry).write.parquet(source)
    run(spark, base, source)
    raw = spark.read.option("recursiveFileLookup", "true").text(f"{base}/raw").first()[0]
    assert "_enqueue_epoch" not in raw and "diagnostic_confidence" in raw
    bad = lake.read_quarantine(spark, f"{base}/quarantine", "out_of_range").first()
    record = json.loads(bad["value"])
    assert (bad["year"], bad["month"], bad["day"]) == ("2024", "02", "01")
    assert record["_validation_error"] == "out_of_range" and record["_quarantined_at"] == "2024-02-01T00:00:00.000000+00:00"
    lost = json.loads(lake.read_quarantine(spark, f"{base}/quarantine", "decode_error").first()["value"])
    assert lost["error"] == "decode_failure" and lost["raw_data"].endswith("!")
    again = lake.reprocess_quarantine(lake.read_quarantine(spark, f"{base}/quarantine", "out_of_range"))
    assert [r["reason"] for r in again.select("reason").distinct().collect()] == ["out_of_range"]


def test_batch_that_runs_again_leaves_one_copy(spark, telemetry):
    base, source = work_dir(spark, "stream"), work_dir(spark, "source")
    fixture.stream_records(telemetry).write.parquet(source)
    run(spark, base, source)
    first = lake.read_raw_json(spark, f"{base}/raw").count()
    records = spark.readStream.schema(STREAM_RECORD).parquet(source)
    ingest.stream_validate(records, f"{base}/raw", f"{base}/quarantine", f"{base}/stats", f"{base}/other-checkpoint").awaitTermination()
    assert lake.read_raw_json(spark, f"{base}/raw").count() == first


def test_curated_keeps_one_copy_of_a_batch_that_runs_again(spark, telemetry):
    base, source = work_dir(spark, "stream"), work_dir(spark, "source")
    fixture.stream_records(telemetry).write.parquet(source)
    run(spark, base, source)
    curated = lambda: ingest.stream_curate(spark, f"{base}/raw", f"{base}/curated", f"{base}/curate", f"{base}/curate-stats").awaitTermination()
    curated()
    records = spark.readStream.schema(STREAM_RECORD).parquet(source)
    ingest.stream_validate(records, f"{base}/raw", f"{base}/quarantine", f"{base}/stats", f"{base}/other-checkpoint").awaitTermination()
    curated()
    table = lake.curated_table(spark, f"{base}/curated")
    assert table.count() == table.select("event_id").distinct().count() == 750
    counts = spark.read.parquet(f"{base}/curate-stats").collect()
    assert [(r["rows_in"], r["rows_kept"], r["rows_dropped"]) for r in counts] == [(750, 750, 0)]


def test_late_records_are_kept_apart_and_counted(spark, telemetry):
    base, source = work_dir(spark, "stream"), work_dir(spark, "source")
    hours = {40: 5, 80: 3, 120: 4, 160: 6, 200: 4}  # sound records by event id
    number, hour = F.col("event_id").cast("int"), F.lit(None).cast("string")
    for key, value in hours.items():
        hour = F.when(number == key, f"2024-01-01T0{value}:00:00Z").otherwise(hour)
    moved = telemetry.filter(number.isin(*hours)).withColumn("timestamp", hour)
    for part in ([40], [80, 120, 160], [200]):
        fixture.stream_records(moved.filter(number.isin(*part))).coalesce(1).write.mode("append").parquet(source)
        run(spark, base, source, late_path=f"{base}/late")
    late = [json.loads(r[0]) for r in spark.read.option("recursiveFileLookup", "true").text(f"{base}/late").collect()]
    assert sorted((r["event_id"], r["_late_before"]) for r in late) == [("200", "2024-01-01T05:00:00Z"), ("80", "2024-01-01T04:00:00Z")]
    stats = spark.read.parquet(f"{base}/stats").agg(F.sum("valid"), F.sum("late")).first()
    assert tuple(stats) == (5, 2) and lake.read_raw_json(spark, f"{base}/raw").count() == 3


def test_repeats_in_a_batch_and_in_later_ones_are_dropped_by_ids_in_files(spark, telemetry):
    session = spark.newSession()  # other streams of the tests' session set its state store
    base, source = work_dir(spark, "stream"), work_dir(spark, "source")
    number, time = F.col("event_id").cast("int"), F.lit(None).cast("string")
    for key, value in {40: "05:00", 80: "05:10", 120: "05:20", 2: "05:00"}.items():  # the last one is given no readable time
        time = F.when(number == key, f"2024-01-01T{value}:00Z").otherwise(time)
    moved = telemetry.filter(number.isin(2, 40, 80, 120)).withColumn("timestamp", time)
    for part in ([40, 80, 2], [40, 120]):
        once = fixture.stream_records(moved.filter(number.isin(*part)))
        once.unionByName(once).coalesce(1).write.mode("append").parquet(source)
        query = ingest.stream_validate(session.readStream.schema(STREAM_RECORD).parquet(source), f"{base}/raw", f"{base}/quarantine",
                                       f"{base}/stats", f"{base}/checkpoint", dedup=True, ingest_time="2024-02-01 00:00:00")
        query.awaitTermination()
        state = query.recentProgress[0]["stateOperators"][0]
        assert any(name.startswith("rocksdb") for name in state["customMetrics"])
        assert session.conf.get("spark.sql.inMemoryColumnarStorage.batchSize") == "10000"
    assert sorted(r["event_id"] for r in lake.read_raw_json(spark, f"{base}/raw").collect()) == ["120", "40", "80"]
    assert [r["reason"] for r in lake.read_quarantine(spark, f"{base}/quarantine").collect()] == ["invalid_timestamp"] * 2


def test_rows_of_a_batch_are_held_on_disk_in_small_blocks(spark, telemetry):
    source = work_dir(spark, "source")
    fixture.stream_records(telemetry).coalesce(1).write.parquet(source)
    routed = validate_route(spark.newSession().read.schema(STREAM_RECORD).parquet(source))
    held = ingest._held(routed)
    try:
        assert held.storageLevel == StorageLevel.DISK_ONLY
        blocks = held._jdf.queryExecution().withCachedData().cacheBuilder().cachedColumnBuffers()
        assert held.count() == 1000 and blocks.count() == 1000 / ingest.CACHED_ROWS
        sent = {r["route"]: r["n"] for r in held.filter("data IS NOT NULL").groupBy("route").agg(F.count("*").alias("n")).collect()}
        assert sent == {"decode_error": held.filter("route = 'decode_error'").count()}
    finally:
        held.unpersist()
