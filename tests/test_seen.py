import pytest
from pyspark.sql import functions as F

from plantwatch.session import work_dir
from plantwatch.streaming import seen


def kept(spark, path, batch_id, *rows, bits=1 << 20):
    frame = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "event_id string, day string, n int")
    result = seen.without_seen(frame, batch_id, path, F.col("event_id"), F.col("day"), bits)
    return sorted((r["event_id"] or "", r["day"] or "") for r in result.collect())


def test_a_repeat_after_weeks_is_dropped(spark):
    path = work_dir(spark, "seen")
    assert kept(spark, path, 0, ("a", "2024-01-01"), ("a", "2024-01-01"), ("b", "2024-01-01"), (None, "2024-01-01"), (None, "2024-01-01"), ("c", None)) == [
        ("", "2024-01-01"), ("", "2024-01-01"), ("a", "2024-01-01"), ("b", "2024-01-01"), ("c", "")]
    for batch in range(1, 4):
        assert kept(spark, path, batch, (f"x{batch}", "2024-01-02")) == [(f"x{batch}", "2024-01-02")]
    assert kept(spark, path, 4, ("a", "2024-01-01"), ("a", "2024-01-02"), ("x1", "2024-01-02"), ("new", "2024-01-01")) == [("a", "2024-01-02"), ("new", "2024-01-01")]
    # a batch that runs again keeps the same; the next one knows it
    assert kept(spark, path, 4, ("a", "2024-01-01"), ("a", "2024-01-02"), ("x1", "2024-01-02"), ("new", "2024-01-01")) == [("a", "2024-01-02"), ("new", "2024-01-01")]
    assert kept(spark, path, 5, ("new", "2024-01-01"), ("a", "2024-01-02")) == []


@pytest.mark.parametrize("bits", [1, 8, 40_000])
def test_false_hits_lose_nothing(spark, bits):
    path, day = work_dir(spark, "full"), "2024-01-01"
    first, second = [(f"e{k}", day) for k in range(300)], [(f"e{k}", day) for k in range(200, 500)]
    assert kept(spark, path, 0, *first, bits=bits) == sorted(first)
    assert kept(spark, path, 1, *second, bits=bits) == sorted(second[100:])
    ids = spark.createDataFrame([(f"e{k}", day) for k in range(500, 2000)], "id string, day string")
    hits = seen.suspects(ids, seen._newest_filters(spark, path, [day], 2), bits).count()
    assert hits == 1500 if bits <= 8 else hits < 15


def test_other_days_are_not_read(spark):
    path = work_dir(spark, "days")
    kept(spark, path, 0, *[(f"e{d}", f"2024-01-{d:02d}") for d in range(1, 29)])
    rows = seen.seen_ids(spark, path, ["2024-01-05"], F.col("batch") < 1)
    assert [f.split("/day=")[1][:10] for f in rows.inputFiles()] and rows.count() == 1
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan or "PartitionFilters: [(day" in plan
    filters = seen._newest_filters(spark, path, ["2024-01-05", "2024-03-01"], 1)
    assert {f.split("/day=")[1][:10] for f in filters.inputFiles()} == {"2024-01-05"}
