import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plantwatch.functions.numbers import exact_round, fixed_text
from plantwatch.functions.times import time_range
from plantwatch.operators import aggregates as ag
from plantwatch.operators import correlate, curate, latest, partials
from plantwatch.plans import activity, kpis, machines
from plantwatch.session import work_dir
from plantwatch.sources import lake


def test_rounding_is_exact(spark):
    values = [0.25, 0.35, 0.05, 0.15, 2.675, 31.15, 33.55, -0.25, -0.35, 0.00095, 123456789.05, 1048576.25, 1e14, 0.0,
              12345678901234.5, 12345678901235.5, 1e13 + 0.125, -12345678901234.5, 98765432109876.55, 1e15 + 0.375, 4e15 + 0.5, 2.0**53, 1e18]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2, 4):
        found = frame.select("x", exact_round(F.col("x"), digits).alias("y")).collect()
        assert [r["y"] for r in found] == [round(r["x"], digits) for r in found]
    texts = frame.filter("x < 1000 AND x >= 0").select("x", fixed_text(F.col("x"), 1).alias("t")).collect()
    assert [r["t"] for r in texts] == [f"{r['x']:.1f}" for r in texts]


def test_newest_second_is_outside_the_range(rows):
    frame = rows(*[{"timestamp": f"2024-01-01T00:00:0{s}Z"} for s in range(4)])
    start, end = datetime(2024, 1, 1, 0, 0, 1), datetime(2024, 1, 1, 0, 0, 3)
    assert [r[0][-3:] for r in time_range(frame, start, end).select("timestamp").collect()] == ["01Z", "02Z"]
    assert time_range(frame, start, end, include_end=True).count() == 3


def test_range_reads_only_its_days(spark, rows):
    path = work_dir(spark, "days")
    frame = rows(*[{"timestamp": f"2024-01-{d:02d}T00:00:00Z", "day": d} for d in range(1, 8)])
    lake.write_curated(frame, path)
    table = time_range(lake.curated_table(spark, path), datetime(2024, 1, 3), datetime(2024, 1, 5)).select("temperature")
    table.collect()
    scan = str(table._jdf.queryExecution().executedPlan().toString())
    assert "PartitionFilters: [" in scan and "(year#" in scan.split("PartitionFilters: [")[1]
    days = table.sparkSession.read.parquet(path).filter("day BETWEEN 3 AND 5").count()
    assert table.count() == 2 and days == 3
    assert ag.temperature_sum(lake.curated_table(spark, path), "cnc_machine", 2024, 1, 3).count() == 1


def test_latest_breaks_ties_by_event_id(rows):
    frame = rows({"event_id": "a", "timestamp": "2024-01-01T00:00:00Z", "status": "warning"},
                 {"event_id": "b", "timestamp": "2024-01-01T00:00:00Z", "status": "critical"}, {"event_id": "0", "timestamp": None})
    assert latest.latest_per_machine(frame).first()["status"] == "critical"


@pytest.mark.parametrize("changed, score", [
    ({}, 98.0), ({"temperature": 95.0}, 90.0), ({"temperature": 1000.0}, 80.0), ({"vibration": 7.0}, 94.0),
    ({"power_consumption": 0.0}, 92.5), ({"power_consumption": 140.0}, 95.5), ({"hydraulic_pressure": 290.0}, 97.0),
    ({"cycle_efficiency": 0.7}, 97.0), ({"degradation_level": 1.0}, 90.0), ({"degradation_level": None}, 98.0),
])
def test_health_score(rows, changed, score):
    assert machines.machines(rows(changed)).first()["health_score"] == score


def test_snapshot_efficiency(rows):
    fleet = lambda *states: rows(*[{"machine_id": f"M{i}", "status": s} for i, s in enumerate(states)])
    percent = lambda frame: latest.fleet_snapshot(frame).first()["operational_efficiency_pct"]
    assert percent(fleet("offline", "healthy", "healthy", "healthy")) == 100.0
    assert percent(fleet("warning", "healthy", "healthy", "healthy")) == 75.0
    assert percent(fleet("offline")) == 0.0


def test_trends_keep_every_bucket(rows):
    frame = rows(*[{"timestamp": f"2024-01-{1 + h // 24:02d}T{h % 24:02d}:{m:02d}:00Z"} for h in range(200) for m in (1, 1, 2)])
    labels = lambda **o: [r["time_label"] for r in ag.hourly_trends(frame, **o).collect()]
    assert len(labels()) == 200 and labels()[5] == "2024-01-01 05:00"
    assert labels(grain="minute")[:2] == ["2024-01-01 00:01", "2024-01-01 00:02"] and len(labels(grain="minute")) == 400
    assert labels(buckets=2, latest=True) == ["2024-01-09 06:00", "2024-01-09 07:00"] and len(labels(grain="day")) == 9
    assert ag.trend_shift(ag.hourly_trends(frame)).first()["total_events"] == 600


def test_single_event_history_falls_back(rows):
    frame = rows({"timestamp": "2024-01-01T05:00:00Z", "temperature": 3.0})
    assert machines.machine_history(frame).count() == 0
    assert machines.history_or_recent(frame).first()["temperature"] == 3.0
    document = machines.machine_analytics(frame).first()
    assert len(document["history"]) == 1 and document["risk_timeline"] is None


def test_unknown_window(rows):
    frame = rows(*[{"timestamp": f"2024-01-0{d}T00:00:00Z"} for d in (1, 2, 4)])
    assert activity.activity_period(frame, "nonsense").window == "7d"
    assert machines.machine_history(frame, "nonsense").count() == machines.machine_history(frame, "24h").count()


def test_trend_without_prior_period(rows):
    frame = rows({"timestamp": "2024-01-01T00:00:00Z"}, {"timestamp": "2024-01-01T00:10:00Z"})
    period = activity.activity_period(frame, "15m")
    row = activity.activity_kpis(activity.activity_base(frame, period), period).first()
    assert (row["total_events"], row["trend_pct"], row["peak_rate_per_min"]) == (1, 0.0, 1.0)


def test_freshness(rows):
    frame = rows({"timestamp": "2024-01-01T00:00:00Z"})
    state = lambda s: activity.pipeline_freshness(frame, datetime(2024, 1, 1, 0, 0, s % 60).replace(minute=s // 60)).first()
    assert [state(s)["producer"] for s in (0, 44, 45, 299, 300)] == ["active", "active", "idle", "idle", "inactive"]
    assert state(300)["stream"] == "inactive"


def test_pipeline_health(spark):
    stats = spark.createDataFrame([(0, 0, 0, 5), (9, 100, 2, 5), (9, 100, 3, 5), (9, 100, 11, 5)],
                                  "ingested long, invocations long, errors long, raw_records long")
    found = activity.pipeline_health(stats).collect()
    assert [r["pipeline_health"] for r in found] == ["warning", "healthy", "warning", "critical"]
    assert found[3]["health_reasons"] == ["Validator error rate is 11.0%"]


def test_empty_fleet(rows):
    table = machines.machines(rows().limit(0))
    row = kpis.business_kpis(table, ag.energy_profile(rows().limit(0))).first()
    assert (row["factory_health_score"], row["most_affected_machine_id"], row["energy_leader_value"]) == (0.0, None, 0.0)


def test_effects_add_up(rows):
    cooler = {"machine_type": "cooling_system", "anomaly_detected": True}
    frame = rows({**cooler, "machine_id": "C1", "anomaly_severity": 0.5}, {**cooler, "machine_id": "C2", "anomaly_severity": 0.25},
                 {"machine_id": "C3", "machine_type": "cooling_system", "degradation_level": 0.29},
                 {"machine_id": "N1", "temperature": 40.0}, {"machine_id": "A1", "machine_type": "robotic_arm", "motor_temperature": 40.0})
    found = {r["machine_id"]: r for r in correlate.correlated_failures(frame).collect()}
    assert set(found) == {"N1", "A1"} and found["N1"]["source_machines"] == 2
    assert found["N1"]["temperature_change"] == 6.0 and found["N1"]["motor_temperature_change"] is None
    assert found["A1"]["motor_temperature_change"] == 6.0


def test_failures_reach_over_the_hour(rows):
    cooler = {"machine_type": "cooling_system", "anomaly_detected": True, "machine_id": "C1", "anomaly_severity": 0.5}
    frame = rows({**cooler, "timestamp": "2024-01-01T10:59:59Z"}, {"machine_id": "N1", "timestamp": "2024-01-01T11:00:01Z"},
                 {"machine_id": "N1", "timestamp": "2024-01-01T10:30:00Z"}, {"machine_id": "N1", "timestamp": "2024-01-01T12:05:00Z"})
    assert correlate.correlated_failures(frame).filter("time_bucket = '2024-01-01T11'").count() == 0
    found = [(r["machine_id"], r["time_bucket"], r["events"], r["source_machines"]) for r in correlate.correlated_within(frame).collect()]
    assert found == [("N1", "2024-01-01T11", 1, 1)]


def _exposed(frame, **options):
    rows = correlate.correlated_within(frame, **options).collect()
    return sorted((r["machine_id"], r["time_bucket"][-2:], r["events"], r["source_machines"], r["severity_sum"], r["max_severity"]) for r in rows)


def test_failures_count_to_the_second_at_both_ends(rows):
    cooler = {"machine_type": "cooling_system", "anomaly_detected": True, "machine_id": "C1", "anomaly_severity": 0.5}
    seen = lambda *times: [{"machine_id": f"N{k}", "timestamp": f"2024-01-01T{t}Z"} for k, t in enumerate(times)]
    frame = rows({**cooler, "timestamp": "2024-01-01T10:00:30Z"},
                 *seen("10:00:05", "10:00:29", "10:00:30", "10:00:31", "11:00:29", "11:00:30", "11:00:31", "11:00:55"))
    assert [r[0] for r in _exposed(frame)] == ["N3", "N4", "N5"]
    assert [r[0] for r in _exposed(frame, distance=1)] == ["N3"]
    assert [r[0] for r in _exposed(frame, distance=3625)] == ["N3", "N4", "N5", "N6", "N7"]


def test_a_machine_counts_once_with_its_latest_failure(rows):
    def cooler(machine, at, severity):
        return {"machine_type": "cooling_system", "anomaly_detected": True, "machine_id": machine, "anomaly_severity": severity, "timestamp": f"2024-01-01T{at}Z"}
    frame = rows(cooler("C1", "23:50:00", 1.0), cooler("C1", "23:50:00", 0.25), cooler("C1", "23:55:00", 0.5), cooler("C2", "23:52:00", 0.125),
                 {"machine_id": "N1", "timestamp": "2024-01-01T23:54:00Z"}, {"machine_id": "N2", "timestamp": "2024-01-01T23:55:00Z"},
                 {"machine_id": "N3", "timestamp": "2024-01-01T23:55:01Z"}, {"machine_id": "N4", "timestamp": "2024-01-02T00:54:00Z"},
                 {"machine_id": "N5", "timestamp": "2024-01-02T00:55:01Z"})
    assert _exposed(frame) == [("N1", "23", 1, 2, 1.125, 1.0), ("N2", "23", 1, 2, 1.125, 1.0), ("N3", "23", 1, 2, 0.625, 0.5), ("N4", "00", 1, 1, 0.5, 0.5)]
    spans = sorted((r["machine_id"], r["closed"] - r["opened"], r["severity"]) for r in correlate.disturbances(frame, cell=3600).collect())
    assert spans == [("C1", 300, 1.0), ("C1", 3600, 0.5), ("C2", 3600, 0.125)]


def test_disturbed_seconds_are_not_sent_through_the_driver(spark, telemetry):
    exposed = correlate.correlated_within(telemetry)
    plan = exposed._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    exposed.collect()
    assert "Broadcast" not in exposed._jdf.queryExecution().executedPlan().toString()


def test_disturbed_seconds_equal_a_sweep(spark):
    dice = random.Random(11)
    spans = [("r", f"M{k}", t, t + dice.randrange(1, 301), dice.randrange(1, 64) / 64) for k in range(200) for t in [dice.randrange(-500, 5000)]]
    frame = spark.createDataFrame(spans, "rule string, machine_id string, opened bigint, closed bigint, severity double")
    found = {r["second"]: (r["source_machines"], r["severity_sum"], r["max_severity"]) for r in correlate.disturbed_seconds(frame, 300).collect()}
    plain = {}
    for second in range(-600, 5500):
        here = [s for _, _, opened, closed, s in spans if opened < second <= closed]
        if here:
            plain[second] = (len(here), sum(here), max(here))
    assert found == plain


def test_history_of_stopped_and_active_machines_is_pruned(spark, rows):
    frame = rows(*[{"machine_id": m, "timestamp": f"2024-01-{d:02d}T{h:02d}:00:00Z", "day": d, "temperature": float(h)}
                   for m, days in (("A", range(1, 20)), ("B", range(1, 5))) for d in days for h in (1, 5, 9)])
    path = work_dir(spark, "history")
    lake.write_curated(frame, path)
    table = lake.curated_table(spark, path)
    got = {(r["machine_id"], r["time_bucket"]) for r in machines.machine_history(table, "24h").collect()}
    assert got == {("A", "2024-01-18T09"), ("A", "2024-01-19T01"), ("A", "2024-01-19T05"), ("B", "2024-01-03T09"), ("B", "2024-01-04T01"), ("B", "2024-01-04T05")}
    index = partials.newest_events(partials.day_partials(table))
    indexed = machines.machine_history(table, "24h", ends=index)
    assert {(r["machine_id"], r["time_bucket"]) for r in indexed.collect()} == got
    scans = [line for line in indexed._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line and path in line]
    assert len(scans) >= 2 and all("PartitionFilters: []" not in line for line in scans)
    one = table.filter(F.col("machine_id") == "B").filter(partials.machine_days(partials.day_partials(table), "B"))
    assert one.count() == 12 and "day#" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    active = machines.machine_history(table.filter("machine_id = 'A'"), "1h")
    plan = active._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("year#") >= 3 and active.count() == 0
    span = activity.time_span(table).first()
    assert (span["min_timestamp"], span["max_timestamp"]) == ("2024-01-01T01:00:00Z", "2024-01-19T09:00:00Z")
    assert curate.retain_recent(table, 4 * 3600).count() == 2


def test_curation_drops_and_counts(spark):
    from pyspark.sql import Observation
    path = work_dir(spark, "raw-json")
    good = '{"machine_id":"M1","machine_type":"cnc_machine","timestamp":"2024-01-02T03:04:05Z","telemetry":{"temperature":"41.5","rpm":"x"}}'
    bad = '{"machine_id":"M1","machine_type":"cnc_machine","timestamp":"2024-01-02 03:04:05"}'
    spark.createDataFrame([(good,), (bad,), ("{broken",)], "value string").write.text(path)
    seen = Observation("dq")
    found = curate.curate(lake.read_raw_json(spark, path), seen).collect()
    assert [(r["temperature"], r["rpm"], r["year"], r["month"], r["day"]) for r in found] == [(41.5, None, 2024, 1, 2)]
    assert seen.get == {"rows_in": 3, "rows_kept": 1, "rows_dropped": 2}


def test_replay_skips_bad_lines_and_keeps_order(spark, tmp_path):
    for day, name, lines in (("2024-01-02", "b.ndjson", ['{"machine_id":"M1","n":3}']),
                             ("2024-01-01", "a.ndjson", ['{"machine_id":"M1","n":1}', "", "{oops", '{"machine_id":"M2","n":2}'])):
        (tmp_path / day).mkdir()
        (tmp_path / day / name).write_text("\n".join(lines))
    path = str(tmp_path)
    number = F.try_variant_get("event", "$.n", "int").alias("n")
    assert [r["n"] for r in lake.replay_events(spark, path).select(number).collect()] == [1, 2, 3]
    assert [r["n"] for r in lake.replay_events(spark, path, date="2024-01-01", machine_id="M2").select(number).collect()] == [2]
    assert [r["date"] for r in lake.replay_dates(spark, path).collect()] == ["2024-01-01", "2024-01-02"]
