"""Schemas of the raw, curated and driver tables."""

from pyspark.sql import types as T

# Column names and their order in the stored tables.
SENSORS = [
    "spindle_speed", "tool_wear", "vibration", "rpm", "power_consumption",
    "hydraulic_pressure", "cycle_time", "joint_load", "movement_delay", "motor_temperature",
    "positional_accuracy", "energy_output", "coolant_flow_rate", "pressure", "arc_stability",
    "energy_usage", "task_completion_rate", "alignment_accuracy", "cycle_efficiency", "temperature",
]
DIAGNOSTIC_COLUMNS = [
    "anomaly_reason", "trigger_metric", "trigger_value", "expected_range",
    "root_cause_candidates", "recommended_actions", "diagnostic_confidence",
]
PARTITION_COLUMNS = ["machine_type", "year", "month", "day"]
REQUIRED_ENVELOPE = ["factory_id", "machine_id", "machine_type", "status", "timestamp"]


def _fields(names, dtype):
    return [T.StructField(n, dtype, True) for n in names]


_ID_FIELDS = _fields(["event_id", "machine_id", "factory_id", "timestamp", "status"], T.StringType())
_STATE_FIELDS = [
    T.StructField("anomaly_detected", T.BooleanType()),
    T.StructField("anomaly_type", T.StringType()),
    T.StructField("anomaly_severity", T.DoubleType()),
    T.StructField("degradation_level", T.DoubleType()),
]
_DIAGNOSTIC_FIELDS = [
    T.StructField(n, T.DoubleType() if n in ("trigger_value", "diagnostic_confidence") else T.StringType())
    for n in DIAGNOSTIC_COLUMNS
]

# 36 data columns plus the four partition columns, in stored order.
CURATED = T.StructType(
    _ID_FIELDS + _STATE_FIELDS + _DIAGNOSTIC_FIELDS + _fields(SENSORS, T.DoubleType())
    + [T.StructField("machine_type", T.StringType())]
    + _fields(["year", "month", "day"], T.IntegerType())
)

# Raw records keep scalars as text, so one odd value becomes null in the cast and never fails the file.
RAW = T.StructType(
    _ID_FIELDS
    + _fields(["machine_type", "anomaly_detected", "anomaly_type", "anomaly_severity", "degradation_level"], T.StringType())
    + _fields(DIAGNOSTIC_COLUMNS, T.StringType())
    + [T.StructField("telemetry", T.StructType(_fields(SENSORS, T.StringType())))]
)

# One undecoded stream record.
STREAM_RECORD = T.StructType([T.StructField("seq", T.StringType()), T.StructField("data", T.StringType())])

# The driver's event table, needed to open it as a stream.
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])
