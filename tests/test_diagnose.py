from pyspark.sql import functions as F

from plantwatch.operators import diagnose as dx

HOT = {"anomaly_detected": True, "temperature": 76.0}


def one(frame):
    return dx.diagnose(frame).orderBy("event_id").collect()


def test_not_anomalous_gives_nulls(rows):
    row = one(rows({"anomaly_detected": False, "anomaly_type": "overheating"}, {"anomaly_detected": None}))
    assert all(r["anomaly_reason"] is None and r["trigger_value"] is None and r["diagnostic_confidence"] == 0.0 for r in row)


def test_rules_in_order(rows):
    found = one(rows(
        {**HOT, "vibration": 16.0, "pressure": 1.0}, {**HOT, "pressure": 3.0, "vibration": 1.0},
        {"anomaly_detected": True, "temperature": 20.0, "rpm": 800.0, "power_consumption": 121.0},
        {"anomaly_detected": True, "temperature": 20.0, "anomaly_type": "unstable_rpm", "rpm": 1200.0}))
    assert [r["diagnostic_confidence"] for r in found] == [0.85, 0.90, 0.80, 0.60]
    assert found[3]["root_cause_candidates"] == (
        "Drive Belt Slippage (45%), Tachometer Feedback Signal Noise (35%), VFD Regulator Failure (20%)")


def test_zero_counts_as_missing(rows):
    frame = rows({**HOT, "coolant_flow_rate": 0.0, "pressure": 10.0}, {**HOT})
    assert [r["diagnostic_confidence"] for r in one(frame)] == [0.60, 0.90]
    strict = dx.diagnose(frame, zero_is_missing=False).orderBy("event_id").collect()
    assert [r["diagnostic_confidence"] for r in strict] == [0.90, 0.90]


def test_missing_trigger_takes_first_sensor_of_the_type(rows):
    row = one(rows({"machine_type": "robotic_arm", "anomaly_detected": True, "anomaly_type": "pressure_fluctuation",
                    "motor_temperature": 30.0, "joint_load": 50.0, "pressure": 9.0}))[0]
    assert (row["trigger_metric"], row["trigger_value"], row["expected_range"]) == ("joint_load", 50.0, "N/A")
    nothing = one(rows({"anomaly_detected": True, "anomaly_type": "overheating"}))[0]
    assert (nothing["trigger_metric"], nothing["trigger_value"]) == ("temperature", None)


def test_own_rules(rows):
    own = {"squeak": ("It squeaks.", "vibration", "quiet", [("Dry bearing", 100)], ["Add oil, then wait"])}
    row = dx.diagnose(rows({"anomaly_detected": True, "anomaly_type": "squeak", "vibration": 2.0, "pressure": 9.0}), own, lists=True).first()
    assert (row["anomaly_reason"], row["trigger_value"], row["action_list"]) == ("It squeaks.", 2.0, ["Add oil, then wait"])


def test_comma_in_action_comes_apart(rows):
    row = dx.diagnostic_record(dx.diagnose(rows({**HOT, "pressure": 3.0, "anomaly_type": "overheating"}))).first()
    assert row["recommendations"] == [
        "Shut down system", "check impeller current and flush tubes", "Perform pressure decay test on line connections",
        "Verify coolant control valve opening ratio"]
    assert row["evidence"] == "Temperature = 76.0 (expected: 10.0 - 75.0 °C)"


def test_record_without_stored_diagnosis(rows):
    row = dx.diagnostic_record(rows({**HOT, "anomaly_reason": "NULL", "anomaly_type": None, "pressure": 10.0})).first()
    assert (row["anomaly_type"], row["confidence"], row["probable_causes"]) == (
        "unknown", 0.60, ["General Mechanical Degradation (100%)"])


def test_ranked_causes(rows):
    frame = rows({"root_cause_candidates": "Main Pump Cavitation (92%), Odd one, Bad (x%)"},
                 {"machine_id": "M2", "machine_type": "hydraulic_press"})
    found = [tuple(r)[:4] for r in dx.ranked_causes(frame).orderBy("machine_id", "rank").collect()]
    assert found == [("M1", 1, "Main Pump Cavitation", 0.92), ("M1", 2, "Odd one", 0.5), ("M1", 3, "Bad", 0.5),
                     ("M2", 1, "Cooling Fan Failure", 0.12), ("M2", 2, "Bearing Wear", 0.08), ("M2", 3, "Sensor Drift", 0.05)]


def test_root_causes_count_each_text_once(rows):
    stored = {"anomaly_detected": True, "root_cause_candidates": "A (50%), B (50%)"}
    frame = rows({**stored, "diagnostic_confidence": 0.5}, {**stored, "diagnostic_confidence": 0.9},
                 {"anomaly_detected": True, "root_cause_candidates": "B (10%)", "diagnostic_confidence": None})
    found = {r["cause"]: (r["count"], r["avg_confidence"]) for r in dx.root_cause_distribution(frame).collect()}
    assert found == {"A": (2, 0.7), "B": (3, 0.67)}


def test_no_python_in_the_plan(rows):
    plan = dx.diagnose(rows(HOT)).select(F.col("anomaly_reason"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
