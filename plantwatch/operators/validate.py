"""Validation of raw records and of typed rows, as columns over the whole table or stream."""

from pyspark.sql import functions as F

from plantwatch import rules
from plantwatch.functions.numbers import exact_round
from plantwatch.functions.stages import opened, staged
from plantwatch.functions.text import quoted, sql_array, sql_map
from plantwatch.functions.times import event_time
from plantwatch.schema import REQUIRED_ENVELOPE, SENSORS

_OBJECT = "map<string,variant>"
_ENVELOPE_TYPES = {
    "event_id": "string", "machine_id": "string", "factory_id": "string", "timestamp": "string", "status": "string",
    "anomaly_detected": "boolean", "anomaly_type": "string", "anomaly_severity": "double", "degradation_level": "double",
    "machine_type": "string"}
_ENVELOPE = f"struct<{', '.join(f'{n} {t}' for n, t in _ENVELOPE_TYPES.items())}>"
TYPED = [*_ENVELOPE_TYPES, *SENSORS]
_SENSORS = f"struct<{', '.join(s + ' double' for s in SENSORS)}>"


def decode_stream(df):
    """Base64 stream records ``(seq, data)`` to parsed records; JSON that is no object counts as unreadable."""
    text = F.try_validate_utf8(F.try_to_binary("data", F.lit("base64")).cast("string"))
    return parse_records(staged(df, value=text))


def parse_records(df):
    """JSON text ``value`` to ``record`` (variant) and its envelope and sensors as typed columns.

    Where a field does not fit its type, the columns of its group (envelope or sensors) are null. Bare NaN and Infinity, which some producers write,
    are read as an infinite number, so such a record fails its range check rather than the parsing. Of repeated keys the
    last counts if ``spark.sql.variant.allowDuplicateKeys`` is on, as in ``session.local_session``; else the record is unreadable.
    """
    loose = F.try_parse_json(F.regexp_replace("value", r"([:,\[]\s*)-?(NaN|Infinity)", "$1" + "1e999"))
    return with_typed(staged(df, record=F.coalesce(F.try_parse_json("value"), loose)))


def with_typed(rows):
    kept = [c for c in rows.columns if c not in TYPED]
    rows = opened(rows.select(*kept), F.try_variant_get("record", "$", _ENVELOPE))
    return opened(rows, F.try_variant_get("record", "$.telemetry", _SENSORS))


def top_level(record="record"):
    """Top level of a record as a map of its fields; null when it is no object."""
    return F.try_variant_get(record, "$", _OBJECT)


def _failure(reason, detail):
    return f"struct({quoted(reason)} AS reason, {detail} AS detail)"


def _text(name):
    return f"try_variant_get(element_at(fields, '{name}'), '$', 'string')"


def _shown(name):
    return f"coalesce({_text(name)}, 'None')"


def _kind(name):
    return f"schema_of_variant(element_at(fields, '{name}'))"


def _names(array):
    return f"concat('[\\'', array_join(array_sort({array}), '\\', \\''), '\\']')"


def envelope_failure():
    """SQL for the first envelope failure.

    Presence is a matter of keys: a JSON null counts as present and fails a later check or none.
    """
    missing = f"array_except({sql_array(REQUIRED_ENVELOPE)}, map_keys(fields))"
    known = f"{_kind('status')} = 'STRING' AND {_text('status')} IN ({', '.join(map(quoted, rules.STATUSES))})"
    named = f"{_kind('machine_id')} = 'STRING' AND {_text('machine_id')} <> ''"
    return f"""CASE
        WHEN size({missing}) > 0 THEN {_failure("missing_envelope_fields", f"concat('Missing: ', {_names(missing)})")}
        WHEN NOT coalesce({_text("timestamp")} RLIKE {quoted(rules.TIMESTAMP_PREFIX)}, false)
            THEN {_failure("invalid_timestamp", f"concat('Bad timestamp: ', {_shown('timestamp')})")}
        WHEN NOT coalesce({known}, false) THEN {_failure("invalid_status", f"concat('Unknown status: ', {_shown('status')})")}
        WHEN NOT coalesce({named}, false) THEN {_failure("invalid_machine_id", "'machine_id must be a non-empty string'")}
        END"""


def _required_by_type(required):
    return f"element_at({sql_map({t: (sql_array(s),) for t, s in required.items()})}, {_text('machine_type')})"


def machine_failure():
    """SQL over the staged ``_needs`` (sensors of the type) and ``_sensors`` (the payload as a map)."""
    absent = "NOT map_contains_key(fields, 'telemetry')"
    keys = f"CASE WHEN {absent} THEN CAST(array() AS array<string>) ELSE map_keys(_sensors) END"
    missing = f"array_except(_needs, {keys})"
    unknown = f"concat('Unrecognised machine_type: ', {_shown('machine_type')})"
    listed = f"concat({_shown('machine_type')}, ' missing: ', {_names(missing)})"
    return f"""CASE
        WHEN _needs IS NULL THEN {_failure("unknown_machine_type", unknown)}
        WHEN NOT ({absent}) AND _sensors IS NULL THEN {_failure("missing_telemetry", "'telemetry field must be a dict'")}
        WHEN size({missing}) > 0 THEN {_failure("missing_telemetry_fields", listed)} END"""


def offending_sensor(limits):
    """SQL for the first sensor, in rule order, that is no number or lies outside its limits.

    Booleans count as numbers.
    """
    def bad(name, low, high):
        reading = f"element_at(_sensors, '{name}')"
        fine = (f"try_variant_get({reading}, '$', 'double') BETWEEN {low}D AND {high}D "
                f"AND schema_of_variant({reading}) <> 'STRING'")
        return f"CASE WHEN {reading} IS NOT NULL AND NOT coalesce({fine}, false) THEN '{name}' END"
    return "coalesce(" + ", ".join(bad(n, lo, hi) for n, (lo, hi) in limits.items()) + ")"


def range_failure(limits):
    """SQL over the staged ``_offender``; only its reading is looked at again."""
    reading = "element_at(_sensors, _offender)"
    kind = f"schema_of_variant({reading})"
    text = f"coalesce(try_variant_get({reading}, '$', 'string'), to_json({reading}))"
    shown = f"CASE {kind} WHEN 'STRING' THEN concat('\\'', {text}, '\\'') WHEN 'VOID' THEN 'None' ELSE {text} END"
    bounds = f"element_at({sql_map({n: f'[{lo}, {hi}]' for n, (lo, hi) in limits.items()})}, _offender)"
    return f"""CASE
        WHEN {kind} RLIKE '^(VOID|STRING|OBJECT|ARRAY)'
            THEN {_failure("non_numeric_field", f"concat(_offender, '=', {shown}, ' is not numeric')")}
        ELSE {_failure("out_of_range", f"concat(_offender, '=', {shown}, ' out of range ', {bounds})")} END"""


def _with_doubts(parsed, required, limits):
    """Add ``_odd``: false for a record whose typed form passes every check, so that few are looked at field by field.

    A sensor given as text or null would slip through the typed form, so the JSON text is searched for one. The
    conditions are staged one by one: each then compiles to a method small enough to be optimised.
    """
    whens = " ".join(f"WHEN {quoted(machine)} THEN " + " AND ".join(f"{n} IS NOT NULL" for n in names)
                     for machine, names in required.items())
    within = " AND ".join(f"coalesce({n} BETWEEN {lo}D AND {hi}D, true)" for n, (lo, hi) in limits.items())
    not_a_number = '"(' + "|".join(limits) + r')"\s*:\s*["n\[{]|\\u'
    named = f"""factory_id IS NOT NULL AND timestamp RLIKE {quoted(rules.TIMESTAMP_PREFIX)}
        AND status IN ({', '.join(map(quoted, rules.STATUSES))}) AND machine_id <> ''
        AND schema_of_variant(try_variant_get(record, '$.machine_id', 'variant')) = 'STRING'"""
    rows = staged(parsed, _complete=F.expr(f"CASE machine_type {whens} END"))
    rows = staged(rows, _within=F.expr(within))
    rows = staged(rows, _named=F.expr(named))
    plain = f"_complete AND _within AND _named AND NOT value RLIKE {quoted(not_a_number)}"
    return staged(rows, _odd=F.expr(f"record IS NOT NULL AND NOT coalesce({plain}, false)"))


def route(parsed, required=None, limits=None):
    """Parsed records with ``route`` (valid, quarantine, decode_error), ``reason`` and ``detail``.

    The first check that fails counts: envelope, machine type and its sensors, ranges.
    """
    required, limits = required or rules.REQUIRED_SENSORS, limits or rules.SENSOR_LIMITS
    rows = _with_doubts(parsed, required, limits)

    def for_odd(sql, and_also="true"):
        return F.expr(f"CASE WHEN _odd AND {and_also} THEN {sql} END")

    rows = staged(rows, fields=F.when(F.col("_odd"), top_level()))
    payload = f"try_variant_get(element_at(fields, 'telemetry'), '$', '{_OBJECT}')"
    rows = staged(rows, _needs=for_odd(_required_by_type(required)), _sensors=for_odd(payload))
    rows = staged(rows, _early=for_odd(f"coalesce({envelope_failure()}, {machine_failure()})", "fields IS NOT NULL"))
    rows = staged(rows, _offender=for_odd(offending_sensor(limits), "_early IS NULL"))
    rows = opened(rows, F.expr(f"coalesce(_early, CASE WHEN _offender IS NOT NULL THEN {range_failure(limits)} END)"))
    unreadable = F.expr("record IS NULL OR (_odd AND fields IS NULL)")
    return rows.select(
        *parsed.columns,
        F.when(unreadable, "decode_error").when(F.col("reason").isNotNull(), "quarantine").otherwise("valid").alias("route"),
        F.when(unreadable, "decode_failure").otherwise(F.col("reason")).alias("reason"),
        F.when(unreadable, "record is not a JSON object in base64").otherwise(F.col("detail")).alias("detail"))


def validate_route(df, required=None, limits=None):
    """Stream records ``(seq, data)`` to routed records, in one pass."""
    return route(decode_stream(df), required, limits)


def batch_counts():
    """Aggregates for ``agg`` or ``observe`` over routed records."""
    return [F.count("*").alias("total"), *[
        F.count_if(F.col("route") == r).alias(n)
        for r, n in (("valid", "valid"), ("quarantine", "quarantined"), ("decode_error", "decode_errors"))]]


def route_stats(routed):
    return routed.agg(*batch_counts())


def reason_counts(routed):
    return routed.groupBy("route", "reason").agg(F.count("*").alias("records"))


def typed_events(routed):
    """Valid records ready for diagnosis; a missing event id gets a placeholder.

    An envelope field of an odd type (a severity given as text) nulls the typed envelope, which the checks do not mind;
    its fields are then read one by one.
    """
    def read(name, dtype):
        return F.coalesce(F.col(name), F.try_variant_get("record", f"$.{name}", dtype)).alias(name)
    kept = [c for c in routed.columns if c not in _ENVELOPE_TYPES]
    rows = routed.select(*kept, *[read(n, t) for n, t in _ENVELOPE_TYPES.items()])
    return rows.withColumn("event_id", F.coalesce("event_id", F.lit("no-event-id")))


# ---- checks of typed rows --------------------------------------------------------------------------------------

def _error(condition, field, message):
    return f"CASE WHEN {condition} THEN struct('{field}' AS field, {message} AS message) END"


def _errors(checks):
    return F.expr(f"array_compact(array({', '.join(checks)}))")


def strict_range_errors(limits=None):
    """All sensors outside the limits of the row's machine type; absent sensors and unknown types pass."""
    return _errors([
        _error(f"machine_type = {quoted(machine)} AND ({name} < {low} OR {name} > {high})", name,
               f"concat('Value ', CAST({name} AS STRING), ' outside range [{low}, {high}]')")
        for machine, ranges in (limits or rules.STRICT_LIMITS).items() for name, (low, high) in ranges.items()])


def strict_range_check(df, limits=None):
    return staged(df, errors=strict_range_errors(limits))


def schema_errors():
    """Ids must be there, names must be known, levels must lie in 0..1 (an absent level takes its default 0)."""
    listed = lambda values: ", ".join(map(quoted, values))
    unknown = lambda name: f"concat('unknown value: ', coalesce({name}, 'None'))"
    checks = [_error(f"coalesce({n}, '') = ''", n, "'must not be empty'") for n in ("event_id", "machine_id", "factory_id")]
    checks.append(_error("timestamp IS NULL", "timestamp", "'is required'"))
    for name, known in (("machine_type", rules.REQUIRED_SENSORS), ("status", rules.STATUSES)):
        checks.append(_error(f"NOT coalesce({name} IN ({listed(known)}), false)", name, unknown(name)))
    checks.append(_error(f"anomaly_type NOT IN ({listed(rules.ANOMALY_TYPES)})", "anomaly_type", unknown("anomaly_type")))
    for name in ("anomaly_severity", "degradation_level"):
        checks.append(_error(f"NOT {name} BETWEEN 0 AND 1", name, "'must lie between 0 and 1'"))
    return _errors(checks)


def schema_check(df):
    return staged(df, errors=schema_errors())


def checked(df, limits=None):
    """Schema and strict range errors together; a row without any is accepted."""
    return staged(df, errors=F.concat(schema_errors(), strict_range_errors(limits)))


def batch_report(df, batch="batch_id"):
    """Accepted and rejected rows per batch. The errors themselves are rows of ``batch_errors``."""
    rejected = F.count_if(F.size("errors") > 0)
    return df.groupBy(batch).agg(
        F.when(rejected == 0, "accepted").otherwise("partial").alias("status"),
        F.count("*").alias("total_received"), F.count_if(F.size("errors") == 0).alias("total_accepted"),
        rejected.alias("total_rejected"))


def batch_errors(df, batch="batch_id"):
    return df.filter(F.size("errors") > 0).select(batch, "event_id", F.explode("errors").alias("e")).select(
        batch, "event_id", "e.*")


def ingest_metrics(df):
    """Totals over checked rows; the rate is per second of event time between the first and last accepted event."""
    good = F.size("errors") == 0
    seconds = (F.unix_timestamp(F.max(F.when(good, event_time()))) - F.unix_timestamp(F.min(F.when(good, event_time()))))
    totals = df.agg(
        F.count_if(good).alias("total_events_ingested"), F.count_if(~good).alias("failed_validations"),
        F.count_distinct(F.when(good, F.col("machine_id"))).alias("active_machine_ids"),
        F.count_if(good & F.coalesce("anomaly_detected", F.lit(False))).alias("anomaly_event_count"),
        F.when(seconds > 0, F.count_if(good) / seconds).otherwise(0.0).alias("rate"))
    return totals.withColumn("events_per_second", exact_round(F.col("rate"), 2)).drop("rate")
