import pytest
from pyspark.sql import functions as F

from plantwatch.operators import aggregates as ag
from plantwatch.operators import partials
from plantwatch.session import work_dir
from plantwatch.streaming.ingest import RAW_BATCH, _overwrite


def stored(frame, path, batch):
    for name, partial in partials.PARTIALS.items():
        _overwrite(partial(frame.withColumn(RAW_BATCH, F.lit(str(batch))), RAW_BATCH), f"{path}/{name}", RAW_BATCH)


def same(ours, theirs):
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    keys = [c for c, t in theirs.dtypes if t != "double"]
    found, wanted = ({tuple(r[k] for k in keys): r for r in df.collect()} for df in (ours, theirs))
    assert set(found) == set(wanted)
    for key, row in wanted.items():
        assert all(found[key][c] == pytest.approx(row[c], abs=1e-9) for c in columns if c not in keys)


def test_views_follow_late_rows_and_replays_without_the_events(spark, telemetry):
    path, number = work_dir(spark, "views"), F.col("event_id").cast("int")
    read = lambda name: partials.partials(spark, path, name)

    def check(events):
        same(partials.machine_health(read("minutes")), ag.machine_health_view(events))
        same(partials.daily_summary(read("minutes")), ag.daily_summary_view(events))
        same(partials.hourly_summary(read("minutes")), ag.hourly_summary_view(events))
        same(partials.timeseries(read("minutes")), ag.timeseries_view(events))
        same(partials.anomaly_summary(read("anomalies")), ag.anomaly_summary_view(events))
    stored(telemetry.filter(number % 3 == 0), path, 0)
    stored(telemetry.filter(number % 3 == 1), path, 1)  # rows of the same minutes
    check(telemetry.filter(number % 3 < 2))
    stored(telemetry.filter(number % 6 == 1), path, 1)  # the batch again with fewer rows
    stored(telemetry.filter(number % 3 == 2), path, 2)
    check(telemetry.filter((number % 3 != 1) | (number % 6 == 1)))


def test_sketches_merge_within_their_bounds(spark):
    rows = spark.range(200_000).select(
        F.format_string("M%05d", F.col("id") % 20_000).alias("machine_id"), F.format_string("2024-01-%02dT%02d:00:00Z", 1 + F.col("id") % 14, F.col("id") % 24).alias("timestamp"),
        F.lit(False).alias("anomaly_detected"), (F.col("id") * 7919 % 200_003 / 200_003).alias("degradation_level"))
    hours = partials.sketch_partials(rows)
    for by, start, end in ((0, None, None), (10, "2024-01-03T00", "2024-01-05T12"), (7, "2024-01-02T05", None)):
        inside = rows.filter((F.substring("timestamp", 1, 13) >= (start or "")) & (F.substring("timestamp", 1, 13) < (end or "9")))
        exact = {r["b"]: r for r in inside.groupBy(F.substring("timestamp", 1, by).alias("b")).agg(
            F.count("*").alias("n"), F.count_distinct("machine_id").alias("m"), F.array_sort(F.collect_list("degradation_level")).alias("v")).collect()}
        for r in partials.range_summary(hours, start, end, by).collect():
            e = exact[r["time_bucket"]]
            assert r["total_events"] == e["n"] and abs(r["active_machines"] / e["m"] - 1) < 0.05
            for share, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")):
                assert abs(sum(x <= r[name] for x in e["v"]) / e["n"] - share) < 0.01
        assert len(exact) == partials.range_summary(hours, start, end, by).count()


def test_hours_without_levels(spark, rows):
    frame = rows({"degradation_level": None}, {"degradation_level": None, "machine_id": "M2"})
    found = partials.range_summary(partials.sketch_partials(frame)).first()
    assert (found["total_events"], found["active_machines"], found["p50"]) == (2, 2, None)
