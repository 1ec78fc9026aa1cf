"""Fleet indicators, recommendations and the texts built from them."""

from pyspark.sql import functions as F

from plantwatch import rules
from plantwatch.functions.numbers import exact_round, fixed_text, percent_of
from plantwatch.functions.sensors import evidence_band
from plantwatch.functions.stages import staged
from plantwatch.functions.text import filled, title_words


def business_kpis(machine_rows, energy_rows):
    """One row of fleet indicators over ``machines`` and ``energy_profile``."""
    status = lambda s: F.count_if(F.col("health_status") == s)
    fleet = machine_rows.agg(
        F.count("*").alias("total_machines"), status("healthy").alias("healthy_count"),
        status("warning").alias("warning_count"), status("critical").alias("critical_count"),
        F.sum("total_events").alias("events"), F.sum("anomaly_events").alias("anomalous"),
        F.avg("max_degradation_level").alias("degradation"),
        F.max("anomaly_rate_percent").alias("worst_rate"),
        F.min(F.struct((-F.col("anomaly_rate_percent")).alias("k"), "machine_id", "machine_type")).alias("worst"))
    leader = energy_rows.orderBy(F.desc("total_energy"), "machine_type").limit(1).select(
        F.struct("machine_type", exact_round(F.col("total_energy"), 0).alias("energy"))).scalar()
    total = F.col("total_machines")
    rate = exact_round(percent_of(F.col("anomalous"), F.col("events")), 2)
    degradation = F.col("degradation")
    any_machine = total > 0
    def shown(value):
        return F.when(any_machine, value).otherwise(F.lit(0.0))
    known = staged(fleet, overall_anomaly_rate_pct=shown(rate))
    rate = F.col("overall_anomaly_rate_pct")
    return known.select(
        shown(exact_round((F.col("healthy_count") * 1.0 + F.col("warning_count") * 0.5) / total * 100.0, 1))
        .alias("factory_health_score"),
        shown(exact_round(F.greatest(F.lit(0.0), 100.0 - degradation * 60.0 - rate * 0.5), 1))
        .alias("production_efficiency_score"),
        "overall_anomaly_rate_pct",
        shown(exact_round(F.least(F.lit(100.0), F.col("critical_count") / total * 60.0 + rate * 1.5 + degradation * 25.0), 1))
        .alias("production_risk_score"),
        F.col("worst.machine_id").alias("most_affected_machine_id"),
        F.col("worst.machine_type").alias("most_affected_machine_type"),
        F.coalesce(exact_round(F.col("worst_rate"), 1), F.lit(0.0)).alias("most_affected_anomaly_rate"),
        leader["machine_type"].alias("energy_leader_type"),
        F.coalesce(leader["energy"], F.lit(0.0)).alias("energy_leader_value"),
        "total_machines", "healthy_count", "warning_count", "critical_count")


def _advice(priority, name, value, text, reason):
    return F.struct(F.lit(priority).alias("priority"), text.alias("recommendation"), reason.alias("reason"),
                    value.cast("double").alias("metric_value"), F.lit(name).alias("metric_name"))


def recommendations(machine_rows, limit=None):
    """Rule-based advice for every machine and the fleet, most urgent first; ``limit`` cuts a report to its length."""
    mid, kind = F.col("machine_id"), title_words(F.col("machine_type"))
    rate, worn, heat = F.col("anomaly_rate_percent"), F.col("max_degradation_level"), F.col("avg_temperature")
    words = {"machine": mid, "kind": kind, "rate": F.concat(fixed_text(rate, 1), F.lit("%")), "percent": fixed_text(worn * 100.0, 0),
             "level": fixed_text(worn, 2), "heat": fixed_text(heat, 1)}

    def advice(case, priority, metric, value):
        return _advice(priority, metric, value, *[filled(text, **words) for text in rules.ADVICE_TEXTS[case]])

    main = (F.when(F.col("health_status") == "critical", advice("critical", "critical", "anomaly_rate_percent", rate))
            .when(rate > 20.0, advice("high_rate", "critical", "anomaly_rate_percent", rate))
            .when(worn > 0.7, advice("worn", "warning", "degradation_level", worn))
            .when(rate > 10.0, advice("rate", "warning", "anomaly_rate_percent", rate)))
    hot = F.when(heat > 80.0, advice("hot", "warning", "avg_temperature", heat))
    per_machine = machine_rows.select(
        mid, kind.alias("machine_type"), F.explode(F.array_compact(F.array(main, hot))).alias("a")
    ).select("a.priority", "machine_id", "machine_type", "a.recommendation", "a.reason", "a.metric_value", "a.metric_name")
    warned = machine_rows.filter("health_status = 'warning'").agg(
        F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set(kind)), 1, 3).alias("types")).filter("n >= 3")
    about = {"n": F.col("n").cast("string"), "kinds": F.array_join("types", ", ")}
    recommendation, reason = (filled(text, **about) for text in rules.ADVICE_TEXTS["fleet"])
    fleet = warned.select(
        F.lit("info").alias("priority"), F.lit(None).cast("string").alias("machine_id"),
        F.lit(None).cast("string").alias("machine_type"), recommendation.alias("recommendation"), reason.alias("reason"),
        F.col("n").cast("double").alias("metric_value"), F.lit("warning_machine_count").alias("metric_name"))
    rank = F.when(F.col("priority") == "critical", 0).when(F.col("priority") == "warning", 1).otherwise(2)
    ranked = per_machine.unionByName(fleet).withColumn("priority_rank", rank).orderBy(
        "priority_rank", "machine_id", "metric_name")
    return ranked if limit is None else ranked.limit(limit)


def _grouped_number(value):
    """1234.5 -> 1,234.5 (at most three decimals)."""
    return F.regexp_replace(F.format_number(value, 3), r"\.?0+$", "")


def _whole(value):
    return F.format_string("%d", F.floor(value + 0.5).cast("bigint"))


def energy_insight(energy_rows):
    """Text on the machine type that uses most energy."""
    top = energy_rows.agg(
        F.sum("total_energy").alias("all"),
        F.min(F.struct((-F.col("total_energy")).alias("k"), "machine_type")).alias("t"))
    label = F.initcap(F.replace("t.machine_type", F.lit("_"), F.lit("")))
    used = -F.col("t.k")
    share = _whole(used / F.when(F.col("all") == 0, 1.0).otherwise(F.col("all")) * 100)
    return top.filter("t IS NOT NULL").select(filled(rules.ENERGY_INSIGHT, kind=label, used=_grouped_number(used), share=share).alias("insight"))


def root_cause_insight(cause_rows):
    """Text on the cause named most often."""
    top = cause_rows.agg(F.sum("count").alias("all"), F.min(
        F.struct((-F.col("count")).alias("k"), "cause", "avg_confidence")).alias("t"))
    count = -F.col("t.k")
    confidence = F.col("t.avg_confidence")
    return top.filter("t IS NOT NULL").select(filled(
        rules.ROOT_CAUSE_INSIGHT, cause=F.col("t.cause"), n=count.cast("string"), share=_whole(count / F.col("all") * 100),
        evidence=F.lower(evidence_band(confidence)), confidence=_whole(confidence * 100)).alias("insight"))


def executive_summary(kpi_row, advice_rows):
    """Status and risk level with the most pressing issue and what to do about it."""
    issue = advice_rows.agg(F.min(F.struct(
        "priority_rank", F.coalesce("machine_id", F.lit("null")).alias("machine_id"), "metric_name", "recommendation",
        "reason")).alias("i"))
    found = issue.select("i").scalar()
    pressing, rank, machine, reason = (found[c] for c in ("recommendation", "priority_rank", "machine_id", "reason"))
    health, risk = F.col("factory_health_score"), F.col("production_risk_score")
    return kpi_row.select(
        F.when(health >= 90, "Stable").when(health >= 75, "At Risk").otherwise("Critical").alias("status"),
        F.when(risk < 30, "Low").when(risk < 60, "Moderate").otherwise("High").alias("risk_level"),
        F.coalesce("most_affected_machine_id", F.lit("None")).alias("most_affected_machine"),
        F.coalesce(pressing, F.lit(rules.NO_ISSUE)).alias("most_significant_issue"),
        F.when(rank == 0, filled(rules.ACTION_NOW, machine=machine, reason=reason))
         .when(rank.isNotNull(), filled(rules.ACTION_SOON, machine=machine, reason=reason))
         .otherwise(rules.ACTION_NONE).alias("recommended_action"))
