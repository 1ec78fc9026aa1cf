from pyspark.sql import functions as F

from plantwatch.schema import CURATED
from plantwatch.session import work_dir
from plantwatch.sources import compact, lake
from plantwatch.streaming.ingest import _overwrite


def live_batch(frame, live, batch):
    _overwrite(frame.select(*CURATED.names).withColumn("raw_batch", F.lit(str(batch))), live, "raw_batch", "machine_type", "year", "month", "day")


def ids(df):
    return sorted(r[0] for r in df.select("event_id").collect())


def files(spark, path):
    return [r["path"] for r in lake.inventory_files(spark, path).collect() if r["path"].endswith(".parquet") and "/version=" in r["path"]]


def test_merged_batches_replays_and_cleaning(spark, rows):
    base = work_dir(spark, "compact")
    live, merged = f"{base}/live", f"{base}/merged"
    event = lambda n, day=1: {"event_id": f"e{n:03d}", "machine_id": f"M{n % 3}", "day": day, "timestamp": f"2024-01-{day:02d}T00:00:{n % 60:02d}Z"}
    table = lambda: compact.compacted_table(spark, live, merged)
    assert compact.compact(spark, live, merged) is None and table().count() == 0
    for batch in range(6):
        live_batch(rows(*[event(10 * batch + k, 1 + batch % 2) for k in range(10)]).repartition(3), live, batch)
    everything = [f"e{n:03d}" for n in range(60)]
    assert ids(table()) == everything
    assert compact.compact(spark, live, merged) == 1 and compact.compact(spark, live, merged) is None
    assert ids(table()) == everything and len(files(spark, merged)) == 2
    # batch 3 comes again with other rows: only its rows are replaced, before and after the next merge
    live_batch(rows(*[event(100 + k, 2) for k in range(4)]), live, 3)
    replaced = sorted([e for e in everything if not "e030" <= e <= "e039"] + [f"e{n}" for n in range(100, 104)])
    assert ids(table()) == replaced
    assert compact.clean(spark, live, merged) == 5 and ids(table()) == replaced
    assert compact.compact(spark, live, merged) == 2 and ids(table()) == replaced
    parts = {r["part"][-5:]: r["version"] for r in compact._manifest(spark, merged, 2)[1].collect()}
    assert parts == {"day=1": 1, "day=2": 2}
    assert compact.clean(spark, live, merged) >= 2 and ids(table()) == replaced
    # merged live folders are gone; a replay of one of them still replaces its rows
    live_batch(rows(event(200, 1)), live, 0)
    final = sorted([e for e in replaced if not e < "e010"] + ["e200"])
    assert ids(table()) == final and compact.compact(spark, live, merged) == 3 and ids(table()) == final


def test_a_merge_that_fails_changes_nothing(spark, rows):
    base = work_dir(spark, "half")
    live, merged = f"{base}/live", f"{base}/merged"
    live_batch(rows({"event_id": "a"}), live, 0)
    # rows of a version without a manifest, as a lost driver leaves them
    rows({"event_id": "zz"}).withColumn("raw_batch", F.lit("9")).write.partitionBy("machine_type", "year", "month", "day").parquet(f"{merged}/version=1")
    assert ids(compact.compacted_table(spark, live, merged)) == ["a"]
    assert compact.compact(spark, live, merged) == 1 and ids(compact.compacted_table(spark, live, merged)) == ["a"]


def test_files_are_near_the_target_size(spark, telemetry):
    base = work_dir(spark, "sizes")
    live, merged = f"{base}/live", f"{base}/merged"
    frame = telemetry.withColumns({c: F.lit(None).cast(CURATED[c].dataType) for c in CURATED.names if c not in telemetry.columns})
    frame = frame.withColumns({"year": F.lit(2024), "month": F.lit(1), "day": F.lit(1), "machine_type": F.lit("cnc_machine")})
    for batch in range(3):
        live_batch(frame.filter(F.col("event_id").cast("int") % 3 == batch).repartition(4), live, batch)
    size = sum(r["length"] for r in lake.inventory_files(spark, live).collect())
    compact.compact(spark, live, merged, target_bytes=size // 4)
    assert 3 <= len(files(spark, merged)) <= 5 and compact.compacted_table(spark, live, merged).count() == 1000
