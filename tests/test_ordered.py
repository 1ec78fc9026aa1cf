"""Chunked row-order operators give the same rows as the uncut history."""

import math

import pytest
from pyspark.sql import functions as F

from plantwatch.operators import aggregates as ag
from plantwatch.operators import features, ordered


def same(a, b):
    columns = sorted(a.columns)
    return a.select(columns).exceptAll(b.select(columns)).isEmpty() and b.select(columns).exceptAll(a.select(columns)).isEmpty()


def rounded(df):
    return df.select(*[F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@pytest.fixture(scope="module")
def hot(telemetry):
    """One machine holds most of the rows."""
    return telemetry.withColumn("machine_id", F.when(F.col("event_id").cast("int") % 4 != 0, "M1").otherwise(F.col("machine_id"))).persist()


@pytest.mark.parametrize("width", [7, 10, 13, 24])
def test_transitions_and_episodes(hot, width):
    assert same(ordered.status_transitions(hot, width=width), ordered.status_transitions(hot, width=0))
    whole = ordered.anomaly_episodes(hot, width=0)
    assert same(ordered.anomaly_episodes(hot, width=width), whole)
    assert same(ordered.anomaly_cascades(whole, width=width), ordered.anomaly_cascades(whole, width=0))


@pytest.mark.parametrize("width", [10, 13])
def test_features_and_labels(hot, width):
    cut, whole = (rounded(features.rolling_features(hot, width=w, label=True)) for w in (width, 0))
    assert same(cut, whole)


def test_only_large_histories_are_cut(hot):
    plan = ordered.choose_chunks(hot, max_rows=700)
    assert [(r[0], len(r[1])) for r in plan.starts.collect()] == [("M1", 2)]
    assert ordered.choose_chunks(hot).starts is None
    known = hot.groupBy("machine_id").agg(F.count("*").alias("n"))
    assert ordered.choose_chunks(hot, max_rows=700, counts=known).starts.count() == 1
    assert same(ordered.status_transitions(hot, max_rows=700), ordered.status_transitions(hot, width=0))
    assert same(ordered.anomaly_episodes(hot, max_rows=700), ordered.anomaly_episodes(hot, width=0))
    cut, whole = (rounded(features.rolling_features(hot, label=True, max_rows=n)) for n in (700, 10_000))
    assert same(cut, whole)


def test_a_burst_is_cut_and_the_rest_is_not(hot, tmp_path):
    """Two thirds of one machine's rows in one second: chunks stay below the bound and copies are few."""
    burst = hot.withColumn("timestamp", F.when((F.col("machine_id") == "M1") & (F.col("event_id").cast("int") % 3 != 0), "2024-01-10T10:10:10Z").otherwise(F.col("timestamp")))
    burst = burst.withColumn("event_id", F.lpad("event_id", 4, "0")).persist()
    cut = ordered.with_neighbours(burst, before=13, max_rows=100)
    sizes = cut.filter("machine_id = 'M1' AND NOT _copy").groupBy("_chunk").count().collect()
    assert 7 <= len(sizes) <= 9 and max(r["count"] for r in sizes) <= 101
    assert cut.filter("_copy").count() == 13 * (len(sizes) - 1)
    assert same(ordered.status_transitions(burst, max_rows=100), ordered.status_transitions(burst, width=0))
    assert same(ordered.anomaly_episodes(burst, max_rows=100), ordered.anomaly_episodes(burst, width=0))
    few, whole = (rounded(features.rolling_features(burst, label=True, max_rows=n)) for n in (100, 10_000))
    assert same(few, whole)


def test_runs(rows):
    frame = rows(*[{"anomaly_detected": kind is not None, "anomaly_type": kind, "anomaly_severity": s, "machine_type": "hydraulic_press"}
                   for kind, s in (("pressure_drop", .3), ("pressure_drop", .6), (None, 0.), ("pressure_drop", .2), ("overheating", .9))])
    found = [(r["anomaly_type"], r["events"], r["duration_seconds"], r["max_severity"])
             for r in ordered.anomaly_episodes(frame).orderBy("start_time").collect()]
    assert found == [("pressure_drop", 2, 1, 0.6), ("pressure_drop", 1, 0, 0.2), ("overheating", 1, 0, 0.9)]
    assert ordered.anomaly_cascades(ordered.anomaly_episodes(frame)).count() == 0


def test_cascade_needs_the_severity(rows):
    frame = rows({"anomaly_detected": True, "anomaly_type": "pressure_drop", "anomaly_severity": 0.55},
                 {"anomaly_detected": True, "anomaly_type": "overheating", "anomaly_severity": 0.1})
    row = ordered.anomaly_cascades(ordered.anomaly_episodes(frame)).first()
    assert (row["source_anomaly"], row["target_anomaly"], row["source_severity"]) == ("pressure_drop", "overheating", 0.55)


def test_alarm_needs_consecutive_periods(rows):
    minute = lambda m, s: {"timestamp": f"2024-01-01T00:{m:02d}:{s:02d}Z", "status": "critical"}
    frame = rows(*[minute(m, s) for m in (0, 1, 3, 5, 6, 7) for s in (1, 2)])
    found = ordered.alarm_periods(frame, F.count_if(F.col("status") == "critical"), 1, 60, 2).orderBy("period_start").collect()
    assert [(r["period_start"], r["value"]) for r in found] == [
        ("2024-01-01T00:01:00Z", 2), ("2024-01-01T00:06:00Z", 2), ("2024-01-01T00:07:00Z", 2)]


@pytest.mark.parametrize("length", [1, 2, 10, 3000])
def test_cascade_chains(spark, length):
    """A chain of episodes on one machine, a break, and another one; a hot machine's chain is found in log rounds."""
    kinds = ["overheating", "unstable_rpm"]
    times = [f"2024-01-01T{k // 3600:02d}:{k // 60 % 60:02d}:{k % 60:02d}Z" for k in range(length + 3)]
    rows = [("M1", "cnc_machine", kinds[k % 2], times[k], times[k], f"e{k}", 0.1 if k == length - 1 else 0.9) for k in range(length + 2)]
    rows += [("M2", "cnc_machine", "overheating", times[0], times[0], "x", 0.9)]
    episodes = spark.createDataFrame(rows, "machine_id string, machine_type string, anomaly_type string, start_time string, end_time string, start_event_id string, max_severity double")
    history = ordered.cascade_history(episodes, [("overheating", "unstable_rpm", 0.5), ("unstable_rpm", "overheating", 0.5)], max_rows=500)
    found = sorted(tuple(r) for r in ordered.cascade_chains(history).collect())
    chain = lambda first, n: ("M1", times[first], kinds[first % 2], n, times[first + n - 1], kinds[(first + n - 1) % 2])
    assert found == ([chain(0, length)] if length > 1 else []) + [chain(length, 2)]
    depths = sorted((r["start_event_id"], r["depth"]) for r in history.collect())
    assert depths == sorted([(f"e{k}", k) for k in range(1, length)] + [(f"e{length + 1}", 1)])


@pytest.mark.parametrize("values", [[], [None], [3.5], [1.0, 2.0], [0.0] * 900 + [5.0] * 50 + [-7.25] * 50, list(range(-3000, 7000)), [1e300, -1e300, 0.5] * 40, [float("nan"), 1.0, 4.0]])
def test_exact_percentiles(spark, values):
    frame = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double").repartition(3)
    real = sorted(v for v in values if v is not None and v == v)
    want = []
    for share in (0.25, 0.5, 0.99):
        place = share * (len(real) - 1)
        low, high = (real[math.floor(place)], real[math.ceil(place)]) if real else (None, None)
        want.append(low + (high - low) * (place - math.floor(place)) if real else None)
    for most in (10, 1_000_000):
        assert ag.exact_percentiles(frame, "v", (0.25, 0.5, 0.99), max_values=most, fineness=100) == want


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101])
def test_chunks_are_found_in_two_steps(spark, n):
    starts = [f"{10 * k:05d}" for k in range(n)]
    places = [f"{p:05d}" for p in (0, 1, 9, 10, 11, 55, 10 * n - 11, 10 * n - 10, 10 * n + 5) if p >= 0]
    frame = spark.createDataFrame([(starts, p) for p in places], "s array<string>, p string")
    found = frame.select("p", ordered._starts_up_to("s", F.col("p"))).collect()
    assert [r[1] for r in found] == [sum(s <= r[0] for s in starts) for r in found]
    low = spark.createDataFrame([(["b", "c", "d", "e"], "a")], "s array<string>, p string")
    assert low.select(ordered._starts_up_to("s", F.col("p"))).first()[0] == 0
