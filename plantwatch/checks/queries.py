"""One registered query per operator. Each takes ``(spark, sf_dir)`` and works on the whole events table.

Averages are rounded to nine and sums to four decimals here, because engines add in different orders.
"""

from datetime import datetime

from pyspark.sql import functions as F

from plantwatch import rules
from plantwatch.functions import sensors as fs
from plantwatch.functions.stages import staged
from plantwatch.functions.times import event_time, time_range
from plantwatch.operators import aggregates as ag
from plantwatch.operators import alarms as alarm_rules
from plantwatch.operators import correlate, curate, diagnose, features, latest, ordered, partials, validate
from plantwatch.plans import activity, kpis, machines
from plantwatch.schema import CURATED, DIAGNOSTIC_COLUMNS, EVENTS, SENSORS
from plantwatch.session import stored, work_dir
from plantwatch.sources import compact, fixture, lake
from plantwatch.streaming import alarms as stream_alarms
from plantwatch.streaming import correlate as stream_correlate
from plantwatch.streaming import ingest, presence, windows

AVERAGE, SUM = 9, 4
INGEST_TIME = "2024-02-01 00:00:00"
NOW = datetime(2024, 1, 31, 0, 0, 0)


def _t(spark, sf_dir):
    return fixture.telemetry(spark, sf_dir)


def _d(spark, sf_dir):
    return diagnose.diagnose(_t(spark, sf_dir))


def _rounded(df, **digits):
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def _on_telemetry(operator, **digits):
    return lambda spark, sf: _rounded(operator(_t(spark, sf)), **digits) if digits else operator(_t(spark, sf))


def _on_diagnosed(operator):
    return lambda spark, sf: operator(_d(spark, sf))


def _listed(column):
    return F.array_join(column, " | ")


# ---- projections and predicates --------------------------------------------------------------------------------

def derive_partitions(df):
    rows = curate.derive_partitions(df.drop("year", "month", "day"))
    return rows.groupBy("year", "month", "day").agg(F.count("*").alias("n"))


def _with_gaps(df):
    number = F.col("event_id").cast("bigint")
    return df.withColumns({
        "machine_id": F.when(number % 11 != 0, F.col("machine_id")),
        "timestamp": F.when(number % 13 == 0, "not-a-date").otherwise(F.col("timestamp"))}).drop("year", "month", "day")


def dq_filter(df):
    return curate.dq_filter(curate.derive_partitions(_with_gaps(df))).groupBy("machine_type").agg(F.count("*").alias("n"))


def flatten(spark, sf):
    """Envelopes as raw JSON in the lake, read back with the raw schema and flattened."""
    path = work_dir(spark, "raw")
    fixture.envelopes(_t(spark, sf)).select("value").write.text(path)
    rows = curate.curate(lake.read_raw_json(spark, path))
    return _sensor_sums(rows)


def _sensor_sums(rows):
    return rows.groupBy("machine_type", "year", "month").agg(
        F.count("*").alias("n"), *[F.round(F.sum(s), SUM).alias(s) for s in SENSORS],
        F.count_if(F.col("anomaly_detected")).alias("anomalies"))


def envelope(df):
    return curate.to_envelope(df).select(
        "event_id", "machine_type", "anomaly_detected", "anomaly_type", "anomaly_severity", "degradation_level",
        F.col("telemetry.temperature").alias("temperature"))


def stamp_metadata(df):
    rows = curate.stamp_metadata(df, F.col("event_id"), node="node-1", now=INGEST_TIME)
    return rows.select("event_id", "metadata.*")


def machine_filter(df):
    return df.filter(F.col("machine_id") == "M00003").select("event_id", "timestamp", "status")


def range_rows(df):
    rows = time_range(df, datetime(2024, 1, 10, 6, 0, 0), datetime(2024, 1, 12, 18, 0, 0))
    return rows.groupBy("machine_type").agg(F.count("*").alias("n"))


def partition_rows(df):
    return df.filter("machine_type = 'assembly_robot' AND year = 2024 AND month = 1 AND day = 15").select(
        "event_id", "machine_id", "temperature")


def bands(df):
    return latest.sensor_bands(df).groupBy("metric", "band").agg(F.count("*").alias("n"))


def severity_bands(df):
    return df.filter("anomaly_detected").groupBy(fs.severity_band(F.col("anomaly_severity")).alias("band")).agg(
        F.count("*").alias("n"))


def confidence_bands(df):
    rows = df.filter("anomaly_detected")
    return rows.groupBy(fs.evidence_band(F.col("diagnostic_confidence")).alias("evidence"),
                        fs.priority_band(F.col("diagnostic_confidence")).alias("priority")).agg(F.count("*").alias("n"))


def derived_status(df):
    return df.groupBy("status", fs.derive_status(F.col("status")).alias("derived")).agg(F.count("*").alias("n"))


# ---- validation ------------------------------------------------------------------------------------------------

def _records(spark, sf):
    return fixture.stream_records(_t(spark, sf))


def validate_route(spark, sf):
    return validate.reason_counts(validate.validate_route(_records(spark, sf)))


def first_failure(spark, sf):
    routed = validate.validate_route(_records(spark, sf))
    return routed.select(F.col("seq").alias("event_id"), "route", "reason", "detail")


def route_stats(spark, sf):
    return validate.route_stats(validate.validate_route(_records(spark, sf)))


def strict_errors(df):
    rows = validate.strict_range_check(df).select("event_id", F.explode("errors").alias("e"))
    return rows.select("event_id", "e.field", "e.message")


def _odd_rows(df):
    number = F.col("event_id").cast("bigint")
    return df.withColumns({
        "machine_id": F.when(number % 17 == 0, "").otherwise(F.col("machine_id")),
        "status": F.when(number % 19 == 0, "broken").otherwise(F.col("status")),
        "anomaly_type": F.when(number % 23 == 0, "gremlins").otherwise(F.col("anomaly_type")),
        "degradation_level": F.when(number % 29 == 0, 1.5).otherwise(F.col("degradation_level"))})


def schema_check(df):
    rows = validate.schema_check(_odd_rows(df)).select(F.explode("errors").alias("e"))
    return rows.groupBy("e.field").agg(F.count("*").alias("n"))


def _batched(df):
    return validate.checked(_odd_rows(df)).withColumn("batch_id", F.floor(F.col("event_id").cast("bigint") / 500))


def batch_report(df):
    return validate.batch_report(_batched(df))


def batch_errors(df):
    return validate.batch_errors(_batched(df)).groupBy("batch_id", "field").agg(F.count("*").alias("n"))


def ingest_metrics(df):
    return validate.ingest_metrics(validate.checked(_odd_rows(df)))


# ---- diagnosis -------------------------------------------------------------------------------------------------

def diagnosed(df):
    return df.select("event_id", *DIAGNOSTIC_COLUMNS)


def diagnosis_lists(df):
    rows = diagnose.diagnose(df, lists=True).filter("anomaly_detected")
    return rows.select("event_id", F.size("cause_list").alias("causes"), F.col("cause_list")[0]["cause"].alias("first_cause"),
                       F.size("action_list").alias("actions"), F.col("action_list")[0].alias("first_action"))


def _flat_record(rows):
    return rows.withColumns({"probable_causes": _listed("probable_causes"), "recommendations": _listed("recommendations")})


def diagnostic_record(df):
    return _flat_record(diagnose.diagnostic_record(df.filter("anomaly_detected")))


def rediagnosed_record(df):
    empty = df.withColumns({c: F.lit(None).cast(CURATED[c].dataType) for c in DIAGNOSTIC_COLUMNS})
    return _flat_record(diagnose.diagnostic_record(empty.filter("anomaly_detected")))


def diagnostics(df):
    return _flat_record(diagnose.diagnostics(df, 50))


def _latest_with_health(df):
    columns = [c for c in df.columns if c != "machine_id"]
    rows = latest.latest_per_machine(df, columns)
    return staged(rows, health_score=fs.health_score()).withColumn("health_status", fs.health_status(F.col("health_score")))


def ranked_causes(df):
    return diagnose.ranked_causes(_latest_with_health(df))


def active_anomaly(df):
    rows = diagnose.active_anomaly(_latest_with_health(df))
    return rows.withColumn("possible_causes", _listed("possible_causes"))


def alert_details(df):
    return latest.alert_details(latest.alerts(df, 200))


def alert_texts(df):
    kinds = df.filter("anomaly_detected").groupBy("anomaly_type").agg(F.count("*").alias("n"))
    return kinds.select("anomaly_type", "n", fs.alert_explanation().alias("explanation"),
                        fs.alert_action().alias("action"))


# ---- windows ---------------------------------------------------------------------------------------------------

def latest_rows(df):
    return latest.latest_per_machine(df, ["timestamp", "event_id", "status", "machine_type", "degradation_level"])


def risk_timeline(df):
    counts = df.groupBy("machine_id").agg(ag.anomaly_count().alias("anomaly_events"))
    return latest.risk_timeline(df, _latest_with_health(df).join(counts, "machine_id"))


def recent_history(df):
    return latest.recent_history(df, 20)


def episodes(df):
    return ordered.anomaly_episodes(df)


def cascades(df):
    return ordered.anomaly_cascades(ordered.anomaly_episodes(df))


def cascade_chains(df):
    """Chains under wider rules: any anomaly type of a machine can set off another one."""
    kinds = sorted({k for source, target, _ in rules.CASCADES for k in (source, target)})
    wider = [(a, b, 0.3) for a in kinds for b in kinds if a != b]
    return ordered.cascade_chains(ordered.cascade_history(ordered.anomaly_episodes(df), wider))


def rolling(df):
    rows = features.rolling_features(df)
    numbers = [c for c in rows.columns if c.startswith(tuple(features.ROLLED)) or c.startswith(("degradation_", "anomaly_freq"))]
    return rows.select("machine_id", "event_id", "recent_anomaly_count", *[F.round(c, 6).alias(c) for c in numbers])


def alarms(df):
    return ordered.alarm_periods(df, F.count_if(F.col("status") == "critical"), 0, seconds=3600, periods=2)


def _metrics(df):
    """Metrics of the three alarms from telemetry, time sixty times as fast: records that are unsound, lag, and critical states."""
    at = F.timestamp_seconds(F.floor(F.unix_timestamp(event_time()) / 60))
    bad = F.when((F.col("event_id").cast("long") % 40).between(1, 10), 1.0).otherwise(0.0)
    values = [("validation_errors", bad), ("consumer_lag_seconds", F.col("anomaly_severity") * 50), ("job_failures", (F.col("status") == "critical").cast("double"))]
    rows = df.select(at.alias("at"), F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in values])).alias("m"))
    return rows.select("m.metric", "at", "m.value")


def documented_alarms(df):
    return alarm_rules.alarm_changes(_metrics(df))


def stream_alarm_changes(spark, sf):
    return _finished(spark, stream_alarms.stream_alarm_changes(_metrics(_events_stream(spark, sf)), delay="0 seconds"), "alarms")


def correlated(df):
    rows = correlate.correlated_failures(df)
    changes = {c: 6 for c in rows.columns if c.endswith("_change") or c == "severity_sum"}
    return _rounded(rows, **changes)


def labels(df):
    return features.rolling_features(df, label=True).filter("label IS NOT NULL").select("machine_id", "event_id", "label")


# ---- plans -----------------------------------------------------------------------------------------------------

def machine_rows(df):
    return _rounded(machines.machines(df), anomaly_rate_percent=AVERAGE)


def health_rows(df):
    return machines.predictive_maintenance(ag.machine_health_view(df))


def history(window):
    def run(df):
        rows = machines.machine_history(df, window)
        return _rounded(rows, **{c: AVERAGE for c in (
            "temperature", "degradation_level", "pressure", "power_consumption", "vibration", "cycle_efficiency")})
    return run


def business(df):
    return kpis.business_kpis(stored(machines.machines(df), "machines"), ag.energy_profile(df))


def advice(limit):
    return lambda df: _rounded(kpis.recommendations(stored(machines.machines(df), "machines"), limit), metric_value=AVERAGE)


def fleet_listing(df):
    rows = machines.fleet_filter_sort(machines.machines(df), search="m000", machine_type="cnc_machine", sort_by="health")
    return rows.select("machine_id", "health_status", "anomaly_events", "total_events")


def machine_document(df):
    rows = machines.machine_analytics(df)
    return rows.select(
        "machine_id", "health_status", "health_score", "last_updated", F.size("history").alias("history_rows"),
        F.size("risk_timeline").alias("timeline_rows"), F.size("root_cause_analysis").alias("causes"),
        F.col("history")[0]["timestamp"].alias("first_history"),
        F.round(F.aggregate("history", F.lit(0.0), lambda t, h: t + F.coalesce(h["temperature"], F.lit(0.0))), 6).alias("history_temperature"),
        F.round(F.aggregate("risk_timeline", F.lit(0.0), lambda t, e: t + e["severity"]), 6).alias("timeline_severity"),
        F.col("risk_timeline")[0]["timestamp"].alias("newest_in_timeline"), F.col("root_cause_analysis")[0]["cause"].alias("first_cause"),
        F.col("predictive_maintenance.failure_risk_pct").alias("failure_risk_pct"),
        F.col("active_anomaly.problem").alias("problem"))


def _activity(part):
    def make(window):
        def run(df):
            period = activity.activity_period(df, window)
            return part(stored(activity.activity_base(df, period), "activity"), period)
        return run
    return make


series = _activity(activity.activity_series)
window_kpis = _activity(activity.activity_kpis)
breakdown = _activity(lambda base, period: activity.activity_breakdown(base))


def insights(df):
    period = activity.activity_period(df, "7d")
    base = stored(activity.activity_base(df, period), "activity")
    rows = activity.activity_insights(activity.activity_kpis(base, period), activity.activity_breakdown(base))
    return rows.select(_listed("insights").alias("insights"))


def pipeline_health(spark, sf):
    routed = validate.validate_route(_records(spark, sf))
    counts = routed.agg(*validate.batch_counts()).select(
        F.col("total").alias("ingested"), F.col("total").alias("invocations"),
        (F.col("quarantined") + F.col("decode_errors")).alias("errors"), F.col("valid").alias("raw_records"))
    rows = activity.pipeline_health(counts)
    return rows.withColumns({"health_reasons": _listed("health_reasons"), "error_rate_pct": F.round("error_rate_pct", 6)})


def executive(df):
    table = stored(machines.machines(df), "machines")
    return kpis.executive_summary(kpis.business_kpis(table, ag.energy_profile(df)), kpis.recommendations(table))


# ---- lake and streams ------------------------------------------------------------------------------------------

def curated_round_trip(spark, sf):
    path = work_dir(spark, "curated")
    lake.write_curated(_d(spark, sf), path)
    return _sensor_sums(lake.curated_table(spark, path))


def registered_table(spark, sf):
    path = work_dir(spark, "table")
    lake.write_curated(_d(spark, sf), path)
    name = "curated_" + path.rsplit("-", 1)[1]
    return ag.daily_volume(lake.register_curated(spark, name, path))


def pruned_sum(spark, sf):
    path = work_dir(spark, "pruned")
    lake.write_curated(_d(spark, sf), path)
    rows = ag.temperature_sum(lake.curated_table(spark, path), "assembly_robot", 2024, 1, 15)
    return _rounded(rows, sum_temperature=SUM)


def rotated_replay(spark, sf):
    path = work_dir(spark, "rotated")
    lake.write_rotated(curate.to_envelope(_t(spark, sf)), path, seconds=21600)
    rows = lake.replay_events(spark, path)
    kind = F.try_variant_get("event", "$.machine_type", "string")
    return rows.groupBy("date", kind.alias("machine_type")).agg(F.count("*").alias("n"))


def inventory(spark, sf):
    raw, curated = work_dir(spark, "layer-raw"), work_dir(spark, "layer-curated")
    fixture.envelopes(_t(spark, sf)).select("value").write.text(raw)
    lake.write_curated(_d(spark, sf), curated)
    return lake.lake_inventory(spark, {"raw": raw, "curated": curated}).select("layer", "files", "bytes", "compression_ratio_pct")


def _events_stream(spark, sf):
    events = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)
    return fixture.project(events)


def _validated_lake(spark, sf, **options):
    base = work_dir(spark, "lake")
    query = ingest.stream_validate(
        fixture.stream_records(_events_stream(spark, sf)), f"{base}/raw", f"{base}/quarantine", f"{base}/stats",
        f"{base}/checkpoint", ingest_time=INGEST_TIME, **options)
    query.awaitTermination()
    return base


def stream_validate(spark, sf):
    base = _validated_lake(spark, sf)
    raw = lake.read_raw_json(spark, f"{base}/raw").select(F.lit("valid").alias("reason"))
    bad = lake.read_quarantine(spark, f"{base}/quarantine").select("reason")
    return raw.unionByName(bad).groupBy("reason").agg(F.count("*").alias("records"))


def stream_stats(spark, sf):
    base = _validated_lake(spark, sf)
    rows = spark.read.parquet(f"{base}/stats")
    return rows.agg(*[F.sum(c).alias(c) for c in ("total", "valid", "quarantined", "decode_errors")])


def stream_dedup(spark, sf):
    base = work_dir(spark, "dedup")
    records = fixture.stream_records(_events_stream(spark, sf))
    twice = records.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    ingest.stream_validate(twice, f"{base}/raw", f"{base}/quarantine", f"{base}/stats", f"{base}/checkpoint",
                           dedup=True, ingest_time=INGEST_TIME).awaitTermination()
    rows = lake.read_raw_json(spark, f"{base}/raw")
    return rows.groupBy("machine_type").agg(F.count("*").alias("n"))


def stream_seen(spark, sf):
    """All records come, and then all of them again: what is kept, and what was counted as repeats."""
    records = fixture.stream_records(_t(spark, sf))
    twice = records.withColumn("part", F.explode(F.array(F.lit(1), F.lit(2))))
    base = _in_two_runs(spark, twice, F.col("part") == 1, lambda stream, base: ingest.stream_validate(
        stream.drop("part"), f"{base}/raw", f"{base}/quarantine", f"{base}/stats", f"{base}/checkpoint", ingest_time=INGEST_TIME, seen_path=f"{base}/seen"))
    kept = lake.read_raw_json(spark, f"{base}/raw").groupBy("machine_type").agg(F.count("*").alias("n"))
    repeats = spark.read.parquet(f"{base}/stats").groupBy().agg(F.sum("repeats").alias("n"))
    return kept.unionByName(repeats.select(F.lit("repeats").alias("machine_type"), "n"))


def stream_curate(spark, sf):
    """Events through both streams: validate to raw, curate to the partitioned table."""
    base = _validated_lake(spark, sf)
    ingest.stream_curate(spark, f"{base}/raw", f"{base}/curated", f"{base}/curate-checkpoint").awaitTermination()
    rows = lake.curated_table(spark, f"{base}/curated")
    return rows.groupBy("machine_type", "diagnostic_confidence").agg(
        F.count("*").alias("n"), F.round(F.sum("temperature"), SUM).alias("temperature"))


def _kept_views(spark, sf):
    """Partials of the views kept by the curating stream, some raw batches of which came a second time."""
    base = _validated_lake(spark, sf)
    curate_now = lambda: ingest.stream_curate(spark, f"{base}/raw", f"{base}/curated", f"{base}/curate-checkpoint", views_path=f"{base}/views").awaitTermination()
    curate_now()
    ingest.stream_validate(fixture.stream_records(_events_stream(spark, sf)), f"{base}/raw", f"{base}/quarantine", f"{base}/stats",
                           f"{base}/checkpoint-again", ingest_time=INGEST_TIME).awaitTermination()
    curate_now()
    return f"{base}/views"


def _kept_view(view, name, **digits):
    return lambda spark, sf: _rounded(view(partials.partials(spark, _kept_views(spark, sf), name)), **digits)


def range_summary(hours):
    """Days merged from the sketches of their hours; the machines are few enough to be counted exactly."""
    rows = partials.range_summary(hours, "2024-01-03T06", "2024-01-24T18")
    return rows.drop("p25", "p50", "p75")


def stream_compacted(spark, sf):
    """The curating stream's files merged, a batch written again after that, and merged once more."""
    base = _validated_lake(spark, sf)
    live, merged = f"{base}/curated", f"{base}/merged"
    curate_now = lambda: ingest.stream_curate(spark, f"{base}/raw", live, f"{base}/curate-checkpoint").awaitTermination()
    curate_now()
    compact.compact(spark, live, merged)
    ingest.stream_validate(fixture.stream_records(_events_stream(spark, sf)), f"{base}/raw", f"{base}/quarantine", f"{base}/stats",
                           f"{base}/checkpoint-again", ingest_time=INGEST_TIME).awaitTermination()
    curate_now()
    compact.compact(spark, live, merged)
    compact.clean(spark, live, merged)
    return _sensor_sums(compact.compacted_table(spark, live, merged))


def stream_replay(spark, sf):
    """A raw batch that is written again after it was curated, and curated again, leaves one copy."""
    base = _validated_lake(spark, sf)
    curate_again = lambda: ingest.stream_curate(spark, f"{base}/raw", f"{base}/curated", f"{base}/curate-checkpoint").awaitTermination()
    curate_again()
    ingest.stream_validate(fixture.stream_records(_events_stream(spark, sf)), f"{base}/raw", f"{base}/quarantine", f"{base}/stats",
                           f"{base}/checkpoint-again", ingest_time=INGEST_TIME).awaitTermination()
    curate_again()
    return lake.curated_table(spark, f"{base}/curated").groupBy("machine_type").agg(F.count("*").alias("n"))


def stream_curate_counts(spark, sf):
    """Rows read, kept and dropped by the curating stream; some raw records have no usable date or machine."""
    base = work_dir(spark, "dropped")
    with_gaps = _with_gaps(_t(spark, sf))
    fixture.envelopes(with_gaps).select("value").write.text(f"{base}/raw")
    ingest.stream_curate(spark, f"{base}/raw", f"{base}/curated", f"{base}/checkpoint", stats_path=f"{base}/stats").awaitTermination()
    return spark.read.parquet(f"{base}/stats").agg(*[F.sum(c).alias(c) for c in ("rows_in", "rows_kept", "rows_dropped")])


def _in_two_runs(spark, rows, first, run):
    """Run a stream over the rows of ``first`` and then, with the same checkpoint, over the others."""
    base = work_dir(spark, "two-runs")
    for part in (first, ~first):
        rows.filter(part).write.mode("append").parquet(f"{base}/source")
        run(spark.readStream.schema(rows.schema).parquet(f"{base}/source"), base).awaitTermination()
    return base


def stream_late(spark, sf):
    """A third of the records come in a second batch; those over an hour older than the first batch's newest are late."""
    records = fixture.stream_records(_t(spark, sf))
    base = _in_two_runs(spark, records, F.col("seq").cast("bigint") % 3 != 0, lambda stream, base: ingest.stream_validate(
        stream, f"{base}/raw", f"{base}/quarantine", f"{base}/stats", f"{base}/checkpoint", ingest_time=INGEST_TIME, late_path=f"{base}/late"))
    on_time = lake.read_raw_json(spark, f"{base}/raw").select("machine_type", F.lit("on_time").alias("route"))
    late = lake.read_raw_json(spark, f"{base}/late").select("machine_type", F.lit("late").alias("route"))
    counted = spark.read.parquet(f"{base}/stats").select(F.lit("counted").alias("machine_type"), F.lit("late").alias("route"), F.col("late").alias("n"))
    rows = on_time.unionByName(late).groupBy("machine_type", "route").agg(F.count("*").alias("n"))
    return rows.unionByName(counted.groupBy("machine_type", "route").agg(F.sum("n").alias("n")))


def stream_status_changes(spark, sf):
    """Changes of status and how long the old one lasted, with the state carried over from batch to batch."""
    base = _in_two_runs(spark, _t(spark, sf), F.col("timestamp") < "2024-01-15", lambda stream, base: windows.status_changes(
        stream, f"{base}/changes", f"{base}/state", f"{base}/stats", f"{base}/checkpoint"))
    return spark.read.parquet(f"{base}/changes").drop("batch")


def stream_presence(spark, sf):
    """Changes of status, silences of over six hours included, from a stream in two runs."""
    def run(stream, base):
        changes = presence.machine_presence(stream, silence=21600)
        return ingest.records_writer(changes, f"{base}/checkpoint").format("parquet").option("path", f"{base}/changes").start()
    base = _in_two_runs(spark, _t(spark, sf), F.col("timestamp") < "2024-01-15", run)
    return spark.read.schema(PRESENCE).parquet(f"{base}/changes")


PRESENCE = "machine_id string, timestamp string, event_id string, previous_status string, status string, seconds_in_previous long"


def stream_correlated(spark, sf):
    """Exposure per machine and hour to failures of the last ten minutes: disturbed seconds, then the join of two streams."""
    base = work_dir(spark, "correlated")
    stream_correlate.stream_disturbances(_events_stream(spark, sf), f"{base}/seconds", f"{base}/spans-checkpoint", distance=600).awaitTermination()
    exposed = stream_correlate.stream_correlated(_events_stream(spark, sf), f"{base}/seconds", distance=600)
    ingest.records_writer(exposed, f"{base}/checkpoint").format("parquet").option("path", f"{base}/out").start().awaitTermination()
    found = spark.read.schema(EXPOSED).parquet(f"{base}/out")
    return found.select("machine_id", "machine_type", F.substring("bucket_start", 1, 13).alias("time_bucket"), "rule", "events", "source_machines",
                        F.round("severity_sum", 6).alias("severity_sum"), "max_severity")


EXPOSED = "machine_id string, machine_type string, bucket_start string, rule string, events long, source_machines long, severity_sum double, max_severity double"


def reprocess(spark, sf):
    """Quarantined range errors validated again under wider limits."""
    base = _validated_lake(spark, sf)
    wider = {**rules.SENSOR_LIMITS, "temperature": (-10.0, 10000.0)}
    rows = lake.reprocess_quarantine(lake.read_quarantine(spark, f"{base}/quarantine", "out_of_range"), limits=wider)
    return rows.groupBy("route").agg(F.count("*").alias("records"))


def _finished(spark, rows, name, mode="append"):
    """Run a stream to its end and read what it wrote."""
    base = work_dir(spark, name)
    writer = ingest.records_writer(rows, f"{base}/checkpoint", mode=mode)
    if mode == "append":
        writer.format("parquet").option("path", f"{base}/out").start().awaitTermination()
    else:
        def replace(batch, _):
            batch.write.mode("overwrite").parquet(f"{base}/out")
        writer.foreachBatch(replace).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


def stream_tumbling(spark, sf):
    rows = _finished(spark, windows.tumbling_summary(_events_stream(spark, sf)), "tumbling")
    return _rounded(rows, avg_degradation_level=AVERAGE)


def stream_sliding(spark, sf):
    rows = _finished(spark, windows.sliding_activity(_events_stream(spark, sf), "6 hours", "3 hours"), "sliding")
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c)
    return rows.select(text("window_start"), text("window_end"), *[c for c in rows.columns if not c.startswith("window")])


def stream_sessions(spark, sf):
    rows = _finished(spark, windows.anomaly_sessions(_events_stream(spark, sf), "24 hours"), "sessions")
    return rows.select("machine_id", "anomaly_type", F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start_time"),
                       "duration_seconds", "events", "max_severity")


def stream_latest(spark, sf):
    return _finished(spark, windows.latest_state(_events_stream(spark, sf)), "latest", mode="complete")


def _stored_features(spark, sf):
    path = work_dir(spark, "features")
    features.feature_table(_t(spark, sf)).write.parquet(path)
    return spark.read.parquet(path)


def classifier_comparison(spark, sf):
    return features.compare_classifiers(_stored_features(spark, sf))


def feature_importances(spark, sf):
    return features.feature_importances(_stored_features(spark, sf))


def view_query(spark, sf):
    ag.register_views(_t(spark, sf))
    return spark.sql("""SELECT h.machine_type, count(*) AS machines, CAST(sum(h.total_events) AS BIGINT) AS events,
                               CAST(sum(h.anomaly_events) AS BIGINT) AS anomalies
                        FROM machine_health_view h GROUP BY h.machine_type""")


QUERIES = {
    # stored aggregates and views
    "count_by_type": _on_telemetry(ag.count_by_type),
    "avg_temp_by_machine": _on_telemetry(ag.avg_temp_by_machine, avg_temp=AVERAGE),
    "anomaly_trend": _on_telemetry(ag.anomaly_trend),
    "most_active": _on_telemetry(ag.most_active),
    "avg_temp_by_type": _on_telemetry(ag.avg_temp_by_type, avg_temp=AVERAGE),
    "anomaly_rate": _on_telemetry(ag.anomaly_rate, anomaly_rate_percent=AVERAGE),
    "daily_volume": _on_telemetry(ag.daily_volume),
    "energy_by_type": _on_telemetry(ag.energy_by_type, total_energy_units=SUM),
    "machine_health_view": _on_telemetry(ag.machine_health_view, anomaly_rate_percent=AVERAGE, avg_temperature=AVERAGE),
    "anomaly_summary_view": _on_telemetry(ag.anomaly_summary_view, avg_anomaly_severity=AVERAGE),
    "daily_summary_view": _on_telemetry(ag.daily_summary_view, avg_degradation_level=AVERAGE),
    "hourly_summary_view": _on_telemetry(ag.hourly_summary_view, avg_degradation_level=AVERAGE),
    "timeseries_view": _on_telemetry(ag.timeseries_view, avg_temperature=AVERAGE, avg_pressure=AVERAGE,
                                     avg_power_consumption=AVERAGE, avg_vibration=AVERAGE, avg_degradation_level=AVERAGE),
    "sum_full": _on_telemetry(ag.temperature_sum, sum_temperature=SUM),
    "sum_pruned": pruned_sum,
    "energy_profile": _on_telemetry(ag.energy_profile),
    "hourly_trends": _on_telemetry(ag.hourly_trends),
    "daily_records": _on_telemetry(ag.daily_records, avg_degradation_level=AVERAGE),
    "anomaly_distribution": _on_telemetry(ag.anomaly_distribution, avg_anomaly_severity=AVERAGE),
    "anomaly_share_top5": _on_telemetry(ag.anomaly_share),
    "telemetry_profile": _on_telemetry(ag.telemetry_profile),
    "degradation_profile": _on_telemetry(ag.degradation_profile, mean=6, std=6, p25=6, p50=6, p75=6),
    "trend_shift": _on_telemetry(lambda t: ag.trend_shift(ag.hourly_trends(t)), early_rate=6, recent_rate=6, delta=6),
    "fleet_snapshot": _on_telemetry(latest.fleet_snapshot),
    "view_registration": view_query,
    # projections and predicates
    "derive_partitions": _on_telemetry(derive_partitions),
    "dq_filter": _on_telemetry(dq_filter),
    "flatten_telemetry": flatten,
    "to_envelope": _on_telemetry(envelope),
    "stamp_metadata": _on_telemetry(stamp_metadata),
    "machine_filter": _on_telemetry(machine_filter),
    "time_range": _on_telemetry(range_rows),
    "partition_filter": _on_telemetry(partition_rows),
    "fleet_filter_sort": _on_telemetry(fleet_listing),
    "retain_recent": _on_telemetry(lambda t: curate.retain_recent(t, 86400).select("event_id", "timestamp")),
    "sensor_bands": _on_telemetry(bands),
    "severity_band": _on_telemetry(severity_bands),
    "confidence_band": _on_diagnosed(confidence_bands),
    "derive_status": _on_telemetry(derived_status),
    # validation
    "first_failure": first_failure,
    "validate_route": validate_route,
    "route_stats": route_stats,
    "strict_range_check": _on_telemetry(strict_errors),
    "schema_check": _on_telemetry(schema_check),
    "batch_report": _on_telemetry(batch_report),
    "batch_errors": _on_telemetry(batch_errors),
    "ingest_metrics": _on_telemetry(ingest_metrics),
    # diagnosis
    "diagnose": _on_diagnosed(diagnosed),
    "diagnosis_lists": _on_telemetry(diagnosis_lists),
    "diagnostic_record": _on_diagnosed(diagnostic_record),
    "rediagnosed_record": _on_telemetry(rediagnosed_record),
    "diagnostics": _on_diagnosed(diagnostics),
    "root_cause_distribution": _on_diagnosed(diagnose.root_cause_distribution),
    "ranked_causes": _on_diagnosed(ranked_causes),
    "active_anomaly": _on_diagnosed(active_anomaly),
    "alert_texts": _on_telemetry(alert_texts),
    # windows, top-k, joins
    "latest_per_machine": _on_telemetry(latest_rows),
    "alerts": _on_telemetry(latest.alerts),
    "alert_details": _on_telemetry(alert_details),
    "risk_timeline": _on_diagnosed(risk_timeline),
    "recent_history": _on_telemetry(recent_history),
    "status_transitions": _on_telemetry(ordered.status_transitions),
    "anomaly_episodes": _on_telemetry(episodes),
    "anomaly_cascades": _on_telemetry(cascades),
    "cascade_history": _on_telemetry(lambda t: ordered.cascade_history(ordered.anomaly_episodes(t))),
    "cascade_chains": _on_telemetry(cascade_chains),
    "rolling_features": _on_telemetry(rolling),
    "next_anomaly_label": _on_telemetry(labels),
    "alarm_periods": _on_telemetry(alarms),
    "documented_alarms": _on_telemetry(documented_alarms),
    "stream_alarm_changes": stream_alarm_changes,
    "correlated_failures": _on_telemetry(correlated),
    "correlated_within": _on_telemetry(lambda t: _rounded(correlate.correlated_within(t), severity_sum=6)),
    # plans
    "machines": _on_telemetry(machine_rows),
    "factory_summary": _on_telemetry(lambda t: machines.factory_summary(machines.machines(t))),
    "machine_history_24h": _on_telemetry(history("24h")),
    "machine_history_7d": _on_telemetry(history("7d")),
    "machine_history_1h": _on_telemetry(history("1h")),
    "predictive_maintenance": _on_telemetry(health_rows),
    "current_conditions": _on_telemetry(latest.current_conditions),
    "machine_analytics": _on_diagnosed(machine_document),
    "business_kpis": _on_telemetry(business),
    "recommendations": _on_telemetry(advice(None)),
    "recommendations_all": _on_telemetry(advice(None)),
    "recommendations_top10": _on_telemetry(advice(10)),
    "time_span": _on_telemetry(activity.time_span),
    "activity_series_24h": _on_telemetry(series("24h")),
    "activity_series_7d": _on_telemetry(series("7d")),
    "activity_kpis_24h": _on_telemetry(window_kpis("24h")),
    "activity_kpis_7d": _on_telemetry(window_kpis("7d")),
    "activity_breakdown": _on_telemetry(breakdown("7d")),
    "activity_insights": _on_telemetry(insights),
    "pipeline_freshness": _on_telemetry(lambda t: activity.pipeline_freshness(t, NOW)),
    "pipeline_health": pipeline_health,
    "energy_insight": _on_telemetry(lambda t: kpis.energy_insight(ag.energy_profile(t))),
    "root_cause_insight": _on_diagnosed(lambda d: kpis.root_cause_insight(diagnose.root_cause_distribution(d))),
    "executive_summary": _on_telemetry(executive),
    # lake and streams
    "curated_round_trip": curated_round_trip,
    "registered_table": registered_table,
    "rotated_replay": rotated_replay,
    "lake_inventory": inventory,
    "stream_validate": stream_validate,
    "stream_stats": stream_stats,
    "stream_dedup": stream_dedup,
    "stream_seen": stream_seen,
    "stream_curate": stream_curate,
    "stream_replay": stream_replay,
    "stream_compacted": stream_compacted,
    "kept_machine_health": _kept_view(partials.machine_health, "minutes", anomaly_rate_percent=AVERAGE, avg_temperature=AVERAGE),
    "kept_hourly_summary": _kept_view(partials.hourly_summary, "minutes", avg_degradation_level=AVERAGE),
    "kept_anomaly_summary": _kept_view(partials.anomaly_summary, "anomalies", avg_anomaly_severity=AVERAGE),
    "kept_range_summary": _kept_view(range_summary, "hours", avg_degradation_level=AVERAGE),
    "stream_curate_counts": stream_curate_counts,
    "stream_late": stream_late,
    "stream_status_changes": stream_status_changes,
    "stream_presence": stream_presence,
    "stream_correlated": stream_correlated,
    "reprocess_quarantine": reprocess,
    "stream_tumbling": stream_tumbling,
    "stream_sliding": stream_sliding,
    "stream_sessions": stream_sessions,
    "stream_latest_state": stream_latest,
    # features and models
    "feature_table": _on_telemetry(lambda t: features.feature_table(t).select("event_id", "label", *[
        F.round(c, 6).alias(c) for c in features.feature_names()])),
    "classifier_comparison": classifier_comparison,
    "feature_importances": feature_importances,
}
