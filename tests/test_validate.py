"""Reason codes of single records, as the stream consumer must give them."""

import base64
import json

import pytest

from plantwatch.operators import validate

GOOD = {"event_id": "test-001", "machine_id": "M001", "machine_type": "cnc_machine", "factory_id": "P1",
        "timestamp": "2026-06-03T10:00:00Z", "status": "healthy",
        "telemetry": {"spindle_speed": 8000.0, "temperature": 42.0, "tool_wear": 5.0, "vibration": 2.1},
        "anomaly_detected": False, "anomaly_type": None, "anomaly_severity": 0.0, "degradation_level": 0.01}


def without(*names):
    return {k: v for k, v in GOOD.items() if k not in names}


def sensors(**changed):
    return {**GOOD, "telemetry": {**GOOD["telemetry"], **changed}}


CASES = {
    "valid": (GOOD, None),
    "no machine id": (without("machine_id"), "missing_envelope_fields"),
    "no event id is fine": (without("event_id"), None),
    "null factory id is fine": ({**GOOD, "factory_id": None}, None),
    "null timestamp": ({**GOOD, "timestamp": None}, "invalid_timestamp"),
    "odd timestamp": ({**GOOD, "timestamp": "not-a-date"}, "invalid_timestamp"),
    "odd status": ({**GOOD, "status": "broken"}, "invalid_status"),
    "empty machine id": ({**GOOD, "machine_id": ""}, "invalid_machine_id"),
    "numeric machine id": ({**GOOD, "machine_id": 7}, "invalid_machine_id"),
    "odd machine type": ({**GOOD, "machine_type": "laser_cutter"}, "unknown_machine_type"),
    "null telemetry": ({**GOOD, "telemetry": None}, "missing_telemetry"),
    "text telemetry": ({**GOOD, "telemetry": "x"}, "missing_telemetry"),
    "absent telemetry": (without("telemetry"), "missing_telemetry_fields"),
    "sensor missing": ({**GOOD, "telemetry": {"temperature": 42.0, "tool_wear": 5.0, "vibration": 2.1}}, "missing_telemetry_fields"),
    "text sensor": (sensors(temperature="hot"), "non_numeric_field"),
    "number as text": (sensors(temperature="42"), "non_numeric_field"),
    "null sensor": (sensors(vibration=None), "non_numeric_field"),
    "list sensor": (sensors(vibration=[1]), "non_numeric_field"),
    "boolean sensor counts": (sensors(vibration=True), None),
    "too hot": (sensors(temperature=9999), "out_of_range"),
    "too cold": (sensors(temperature=-50.0), "out_of_range"),
    "upper bound counts": (sensors(temperature=500.0), None),
    "NaN": (sensors(temperature=float("nan")), "out_of_range"),
    "infinite": (sensors(temperature=float("inf")), "out_of_range"),
    "foreign sensor is checked": (sensors(rpm=99999), "out_of_range"),
    "foreign text sensor": (sensors(rpm="fast"), "non_numeric_field"),
    "unknown extra field": (sensors(colour="red"), None),
    "first rule in order wins": (sensors(temperature=9999, rpm="x"), "out_of_range"),
    "odd severity type still routed": ({**GOOD, "anomaly_severity": "high"}, None),
}


def encode(event):
    return base64.b64encode(json.dumps(event).encode()).decode()


def routed(spark, *data):
    frame = spark.createDataFrame([(str(i), d) for i, d in enumerate(data)], "seq string, data string")
    return {int(r["seq"]): r for r in validate.validate_route(frame).collect()}


def test_reasons(spark):
    names = list(CASES)
    found = routed(spark, *[encode(CASES[n][0]) for n in names])
    assert {n: found[i]["reason"] for i, n in enumerate(names)} == {n: CASES[n][1] for n in names}
    assert all(found[i]["route"] == ("quarantine" if CASES[n][1] else "valid") for i, n in enumerate(names))


def test_details(spark):
    found = routed(spark, encode(without("machine_id", "status")), encode(sensors(temperature=9999)), encode(sensors(temperature="hot")),
                   encode({**GOOD, "telemetry": {"temperature": 1.0}}))
    assert [found[i]["detail"] for i in range(4)] == [
        "Missing: ['machine_id', 'status']", "temperature=9999 out of range [-10.0, 500.0]", "temperature='hot' is not numeric",
        "cnc_machine missing: ['spindle_speed', 'tool_wear', 'vibration']"]


@pytest.mark.parametrize("data", ["not base64!", encode([1, 2]), encode("text"), base64.b64encode(b"{oops").decode(),
                                  base64.b64encode(b"\xff\xfe").decode(), None])
def test_unreadable(spark, data):
    assert routed(spark, data)[0]["route"] == "decode_error"


def test_the_last_of_repeated_keys_counts(spark):
    text = json.dumps(GOOD)[:-1] + ', "machine_id": "M-LAST"}'
    row = validate.typed_events(validate.validate_route(spark.createDataFrame([("1", base64.b64encode(text.encode()).decode())], "seq string, data string"))).first()
    assert (row["route"], row["machine_id"]) == ("valid", "M-LAST")


def test_batch_counts(spark):
    frame = spark.createDataFrame([("1", encode(GOOD)), ("2", encode(without("status"))), ("3", "!")], "seq string, data string")
    assert validate.route_stats(validate.validate_route(frame)).first().asDict() == {
        "total": 3, "valid": 1, "quarantined": 1, "decode_errors": 1}


def test_typed_events(spark):
    frame = spark.createDataFrame([("1", encode(without("event_id")))], "seq string, data string")
    row = validate.typed_events(validate.validate_route(frame)).first()
    assert (row["event_id"], row["spindle_speed"], row["rpm"]) == ("no-event-id", 8000.0, None)


def test_strict_ranges_list_all_errors(rows):
    frame = rows({"machine_type": "conveyor_motor", "rpm": 99999.0, "temperature": -500.0, "power_consumption": 5.2},
                 {"machine_type": "unknown", "rpm": 99999.0}, {"machine_type": "conveyor_motor"})
    found = [[e["field"] for e in r["errors"]] for r in validate.strict_range_check(frame).orderBy("event_id").collect()]
    assert found == [["rpm", "temperature"], [], []]


def test_schema_check(rows):
    frame = rows({}, {"machine_id": None, "anomaly_severity": 1.2, "anomaly_type": "none"}, {"degradation_level": float("nan")},
                 {"machine_type": None, "anomaly_severity": None})
    found = [[e["field"] for e in r["errors"]] for r in validate.schema_check(frame).orderBy("event_id").collect()]
    assert found == [[], ["machine_id", "anomaly_severity"], ["degradation_level"], ["machine_type"]]
