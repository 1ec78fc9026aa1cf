"""Rule-based diagnosis of anomalous readings, as expressions over the whole table or stream."""

from pyspark.sql import functions as F

from plantwatch import rules
from plantwatch.functions.numbers import exact_round, fixed_text
from plantwatch.functions.stages import staged
from plantwatch.functions.text import (
    first_match, lookup, missing_text, quoted, split_list, sql_array, sql_map, title_words,
)
from plantwatch.schema import DIAGNOSTIC_COLUMNS, SENSORS


class RuleSet:
    """Rules laid out as literal arrays, so a row carries two small numbers until the texts are looked up.

    The tables are constants of a dozen rows: no join is needed, and a stream uses them the same way.
    """

    def __init__(self, catalogue=None, default=None):
        catalogue = catalogue or rules.CATALOGUE
        self.entries = list(catalogue.values()) + [default or rules.CATALOGUE_DEFAULT]
        self.numbers = {name: i for i, name in enumerate(catalogue, 1)}
        self.findings = [(rules.BASE_CONFIDENCE, e[3], e[4]) for e in self.entries]
        self.findings += [rules.HOT_AND_SHAKING, rules.HOT_AND_STARVED, rules.SLOW_AND_HUNGRY]

    def entry_number(self, kind):
        """SQL number of the catalogue entry of an anomaly type; the default entry for an unknown one."""
        return f"coalesce(element_at({sql_map(self.numbers)}, {kind}), {len(self.entries)})"

    def finding_number(self, kind, zero_is_missing=True):
        """SQL number of the first sensor-correlation rule that holds, else of the entry's own causes.

        With ``zero_is_missing`` a zero reading counts as absent, and an absent pressure reads as 0, so any hot
        machine without a pressure sensor matches the second rule; that is the rule set's own behaviour.
        """
        def sensor(default, *names):
            given = [f"nullif({n}, 0D)" if zero_is_missing else n for n in names]
            return f"coalesce({', '.join(given)}, {default}D)"

        first = len(self.entries) + 1
        hot = sensor(0, "temperature", "motor_temperature") + " > 75"
        pressure = sensor(0, "pressure", "hydraulic_pressure")
        return f"""CASE
            WHEN {hot} AND {sensor(0, "vibration")} > 15 THEN {first}
            WHEN {hot} AND ({pressure} < 4 OR {sensor(100, "coolant_flow_rate")} < 15
                            OR ({kind} = 'pressure_drop' AND {pressure} < 1800)) THEN {first + 1}
            WHEN {sensor(5000, "rpm", "spindle_speed")} < 900
                 AND {sensor(0, "power_consumption", "energy_usage")} > 120 THEN {first + 2}
            ELSE {self.entry_number(kind)} END"""

    def stage(self, df, active, zero_is_missing=True):
        """Add the two numbers, ``_entry`` and ``_finding``, null where ``active`` is false."""
        kind = "coalesce(nullif(anomaly_type, ''), 'unknown')"
        return staged(df, _entry=F.when(active, F.expr(self.entry_number(kind))),
                      _finding=F.when(active, F.expr(self.finding_number(kind, zero_is_missing))))

    def columns(self, sensor_order=None):
        """The seven diagnostic columns and the two clean lists, from the staged numbers."""
        def entry(values):
            return F.expr(f"get({sql_array(values)}, _entry - 1)")

        def finding(values):
            return f"get(array({', '.join(values)}), _finding - 1)"

        metrics = [e[1] for e in self.entries]
        configured = "CASE " + " ".join(f"WHEN _entry = {i} THEN {m}" for i, m in enumerate(metrics, 1)) + " END"
        fallback = f"CASE WHEN _entry IS NOT NULL AND {configured} IS NULL THEN {first_reading(sensor_order)} END"
        causes = ["array(" + ", ".join(f"struct({quoted(n)} AS cause, {p / 100.0}D AS prob)" for n, p in c) + ")"
                  for _, c, _ in self.findings]
        return {
            "anomaly_reason": entry([e[0] for e in self.entries]),
            "trigger_metric": F.expr(f"coalesce(({fallback}).metric, get({sql_array(metrics)}, _entry - 1))"),
            "trigger_value": F.expr(f"coalesce({configured}, ({fallback}).value)"),
            "expected_range": entry([e[2] for e in self.entries]),
            "root_cause_candidates": F.expr(finding([quoted(rules.causes_text(c)) for _, c, _ in self.findings])),
            "recommended_actions": F.expr(finding([quoted(rules.actions_text(a)) for _, _, a in self.findings])),
            "diagnostic_confidence": F.expr(finding([f"{float(c)}D" for c, _, _ in self.findings])),
            "cause_list": F.expr(finding(causes)),
            "action_list": F.expr(finding([sql_array(a) for _, _, a in self.findings])),
        }


def first_reading(sensor_order=None):
    """SQL for the first present sensor of a row: the machine type's own order, then the stored order."""
    def first(names):
        given = [f"CASE WHEN {n} IS NOT NULL THEN struct('{n}' AS metric, {n} AS value) END" for n in names]
        return f"coalesce({', '.join(given)})"
    if sensor_order is not None:
        return first(sensor_order)
    own = " ".join(f"WHEN '{machine}' THEN {first(names)}" for machine, names in rules.REQUIRED_SENSORS.items())
    return f"coalesce(CASE machine_type {own} END, {first(SENSORS)})"


def diagnose(df, catalogue=None, default=None, zero_is_missing=True, lists=False):
    """Add the seven diagnostic columns; rows without an anomaly get nulls and confidence 0.

    ``lists`` adds the causes and actions as arrays, which unlike the comma-joined texts split without loss.
    """
    names = DIAGNOSTIC_COLUMNS + (["cause_list", "action_list"] if lists else [])
    kept = [c for c in df.columns if c not in names]
    rule_set = RuleSet(catalogue, default)
    found = rule_set.columns()
    found["diagnostic_confidence"] = F.coalesce(found["diagnostic_confidence"], F.lit(0.0))
    rows = rule_set.stage(df.select(*kept), F.col("anomaly_detected"), zero_is_missing)
    return rows.select(*kept, *[found[n].alias(n) for n in names])


# Sensors a stored row is re-diagnosed from, in the order tried for a missing trigger.
_RECORD_SENSORS = [
    "temperature", "motor_temperature", "vibration", "pressure", "hydraulic_pressure", "coolant_flow_rate", "rpm",
    "spindle_speed", "power_consumption", "energy_usage", "tool_wear", "movement_delay", "arc_stability",
    "alignment_accuracy", "cycle_efficiency", "task_completion_rate",
]


def _fill_missing_diagnosis(df):
    """Stored diagnosis, computed afresh where the reason is missing."""
    kept = [c for c in df.columns if c not in DIAGNOSTIC_COLUMNS]
    rule_set = RuleSet()
    fresh = rule_set.columns(_RECORD_SENSORS)
    rows = rule_set.stage(df, missing_text(F.col("anomaly_reason")))
    return staged(rows, **{n: F.when(F.col("_entry").isNotNull(), fresh[n]).otherwise(F.col(n))
                           for n in DIAGNOSTIC_COLUMNS}).select(*kept, *DIAGNOSTIC_COLUMNS)


def actions_of(column):
    """Comma-joined actions to an array without numbering; an action that holds a comma comes apart."""
    stripped = F.transform(split_list(column), lambda a: F.trim(F.regexp_replace(a, r"^[0-9]\.\s*", "")))
    return F.filter(stripped, lambda a: a != "")


def diagnostic_record(df):
    """Readable diagnosis of each (anomalous) row."""
    rows = _fill_missing_diagnosis(df)
    text = lambda name: F.when(~missing_text(F.col(name)), F.col(name))
    evidence = F.concat(
        title_words(F.coalesce(F.nullif(F.col("trigger_metric"), F.lit("")), F.lit("sensor"))), F.lit(" = "),
        fixed_text(F.coalesce("trigger_value", F.lit(0.0)), 1), F.lit(" (expected: "),
        F.coalesce(F.nullif(F.col("expected_range"), F.lit("")), F.lit("N/A")), F.lit(")"))
    return rows.select(
        "event_id", "machine_id", "machine_type", "timestamp",
        F.coalesce(F.nullif(F.col("anomaly_type"), F.lit("")), F.lit("unknown")).alias("anomaly_type"),
        F.coalesce(F.nullif(F.col("anomaly_reason"), F.lit("")), F.lit("Anomaly detected in machine parameters.")).alias("explanation"),
        evidence.alias("evidence"),
        split_list(text("root_cause_candidates")).alias("probable_causes"),
        actions_of(text("recommended_actions")).alias("recommendations"),
        F.coalesce("diagnostic_confidence", F.lit(0.60)).alias("confidence"))


def diagnostics(df, limit=50, machine_id=None):
    """Newest anomalous events with their diagnosis; the cut comes first, so few rows are diagnosed."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    rows = df.filter("anomaly_detected")
    if machine_id is not None:
        rows = rows.filter(F.col("machine_id") == machine_id)
    return diagnostic_record(rows.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(limit))


def root_cause_distribution(df, limit=None):
    """How often each cause is named among the anomalous rows, with the mean confidence.

    Rows are counted per candidate text before it is split, so only the few distinct texts are exploded. Confidences are
    added up as decimals, so the mean, and how a tie rounds, doesn't depend on the order of the rows.
    """
    rows = df.filter("anomaly_detected")
    if limit is not None:
        rows = rows.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(limit)
    rule_set = RuleSet()
    fresh = rule_set.columns(_RECORD_SENSORS)
    rows = rule_set.stage(rows, missing_text(F.col("root_cause_candidates")))
    texts = rows.select(
        F.coalesce(fresh["root_cause_candidates"], "root_cause_candidates").alias("causes"),
        F.coalesce(fresh["diagnostic_confidence"], "diagnostic_confidence", F.lit(0.6)).alias("confidence"))
    counted = texts.groupBy("causes", "confidence").agg(F.count("*").alias("n"))
    named = counted.select(F.explode(split_list(F.col("causes"))).alias("item"), "confidence", "n")
    return named.groupBy(F.trim(F.substring_index("item", "(", 1)).alias("cause")).agg(
        F.sum("n").alias("count"),
        (F.sum(F.col("confidence").cast("decimal(18,10)") * F.col("n")).cast("double") / F.sum("n")).alias("mean")
    ).select("cause", "count", exact_round(F.col("mean"), 2).alias("avg_confidence")).orderBy(F.desc("count"), "cause")


def _ranked(item):
    percent = F.trim(F.translate(F.get(F.split(item, r"\("), F.lit(1)), ")%", ""))
    name = F.trim(F.substring_index(item, "(", 1))
    return F.struct(
        name.alias("cause"), F.coalesce(percent.try_cast("double") / 100.0, F.lit(0.5)).alias("confidence"),
        F.coalesce(lookup(rules.CAUSE_EXPLANATIONS, name), F.lit(rules.EXPLANATION_WITH_CANDIDATES)).alias("explanation"))


def typical_causes():
    """Causes assumed for a machine without candidates, by its type."""
    def listed(causes):
        return "array(" + ", ".join(
            f"struct({quoted(name)} AS cause, {confidence}D AS confidence, "
            f"{quoted(rules.CAUSE_EXPLANATIONS.get(name, rules.EXPLANATION_WITHOUT_CANDIDATES))} AS explanation)"
            for name, confidence in causes) + ")"
    *cases, (_, rest) = rules.TYPICAL_CAUSES
    return F.expr(first_match("coalesce(machine_type, 'unknown')", [(w, listed(c)) for w, c in cases], listed(rest)))


def cause_ranking():
    """Array of (cause, confidence, explanation): the parsed candidates, or the typical causes."""
    candidates = F.col("root_cause_candidates")
    return F.when(missing_text(candidates), typical_causes()).otherwise(
        F.transform(split_list(candidates), _ranked))


def ranked_causes(latest):
    """One row per machine and cause; takes one row per machine."""
    return latest.select("machine_id", F.posexplode(cause_ranking()).alias("position", "item")).select(
        "machine_id", (F.col("position") + 1).alias("rank"), "item.*")


def active_anomaly_struct():
    kind = "coalesce(nullif(anomaly_type, ''), 'unknown_sensor_anomaly')"
    *cases, (_, rest_causes, rest_impact) = rules.ACTIVE_ANOMALY_TEXTS
    causes = F.expr(first_match(kind, [([w], sql_array(c)) for w, c, _ in cases], sql_array(rest_causes)))
    impact = F.expr(first_match(kind, [([w], quoted(i)) for w, _, i in cases], quoted(rest_impact)))
    candidates, actions = F.col("root_cause_candidates"), F.col("recommended_actions")
    return F.struct(
        title_words(F.expr(kind)).alias("problem"),
        F.coalesce("diagnostic_confidence", F.lit(0.85)).alias("confidence"),
        F.when(missing_text(candidates), causes).otherwise(split_list(candidates)).alias("possible_causes"),
        impact.alias("operational_impact"),
        F.when(missing_text(actions), F.lit(rules.DEFAULT_ACTION))
         .otherwise(F.trim(F.substring_index(actions, ",", 1))).alias("recommended_action"))


def active_anomaly(machines):
    """Problem, causes, impact and first action of machines that are anomalous or not healthy."""
    shown = F.col("anomaly_detected") | (F.col("health_status") != "healthy")
    return machines.filter(F.coalesce(shown, F.lit(False))).select("machine_id", active_anomaly_struct().alias("a")).select(
        "machine_id", "a.*")
