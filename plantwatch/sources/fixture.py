"""Machine telemetry derived from the driver's ``events`` table, for tests, checks and the bench.

The text runs unchanged in Spark and in DuckDB; ``{events}`` is the table it reads.
"""

from pyspark.sql import functions as F

from plantwatch.functions.stages import staged
from plantwatch.rules import REQUIRED_SENSORS

PROJECTION = """
e AS (
  SELECT event_id AS eid, user_id AS u, event_type AS et, value AS v,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
         CAST(date_trunc('second', ts) AS STRING) AS s
  FROM {events}),
t AS (
  SELECT e.*, CASE u % 8 WHEN 0 THEN 'cnc_machine' WHEN 1 THEN 'conveyor_motor' WHEN 2 THEN 'hydraulic_press'
    WHEN 3 THEN 'robotic_arm' WHEN 4 THEN 'industrial_turbine' WHEN 5 THEN 'cooling_system'
    WHEN 6 THEN 'welding_unit' ELSE 'assembly_robot' END AS mt,
    (et = 'error' OR v > 100.0) AS a
  FROM e),
telemetry AS (
  SELECT CAST(eid AS STRING) AS event_id,
    concat('M', lpad(CAST(u AS STRING), 5, '0')) AS machine_id, 'PLANT_01' AS factory_id,
    concat(replace(s, ' ', 'T'), 'Z') AS timestamp,
    CASE et WHEN 'purchase' THEN 'warning' WHEN 'error' THEN 'critical' WHEN 'signup' THEN 'offline' ELSE 'healthy' END AS status,
    a AS anomaly_detected,
    CASE WHEN NOT a THEN NULL
      WHEN mt = 'cnc_machine' THEN CASE WHEN k % 2 = 0 THEN 'excessive_tool_wear' ELSE 'vibration_anomaly' END
      WHEN mt = 'conveyor_motor' THEN CASE WHEN k % 2 = 0 THEN 'overheating' ELSE 'unstable_rpm' END
      WHEN mt = 'hydraulic_press' THEN CASE WHEN k % 2 = 0 THEN 'pressure_drop' ELSE 'overheating' END
      WHEN mt = 'robotic_arm' THEN CASE WHEN k % 2 = 0 THEN 'motor_overheating' ELSE 'movement_delay_spike' END
      WHEN mt = 'industrial_turbine' THEN CASE WHEN k % 2 = 0 THEN 'vibration_anomaly' ELSE 'unstable_rpm' END
      WHEN mt = 'cooling_system' THEN CASE WHEN k % 2 = 0 THEN 'pressure_fluctuation' ELSE 'coolant_reduction' END
      WHEN mt = 'welding_unit' THEN CASE WHEN k % 2 = 0 THEN 'unstable_arc' ELSE 'energy_spike' END
      ELSE CASE WHEN k % 2 = 0 THEN 'alignment_degradation' ELSE 'efficiency_drop' END END AS anomaly_type,
    CASE WHEN a THEN least(CAST(1 AS DOUBLE), v / 200) ELSE CAST(0 AS DOUBLE) END AS anomaly_severity,
    CAST(k AS DOUBLE) / 99 AS degradation_level,
    CASE WHEN mt = 'cnc_machine' THEN CAST(500 + k * 75 AS DOUBLE) END AS spindle_speed,
    CASE WHEN mt = 'cnc_machine' THEN CAST(k AS DOUBLE) END AS tool_wear,
    CASE WHEN mt = 'cnc_machine' THEN v / 6 WHEN mt = 'industrial_turbine' THEN CAST(k AS DOUBLE) / 4 END AS vibration,
    CASE WHEN mt = 'conveyor_motor' THEN CAST(600 + k * 10 AS DOUBLE) WHEN mt = 'industrial_turbine' THEN CAST(500 + k * 100 AS DOUBLE) END AS rpm,
    CASE WHEN mt = 'conveyor_motor' THEN v * CAST(1.5 AS DOUBLE) END AS power_consumption,
    CASE WHEN mt = 'hydraulic_press' THEN CAST(1500 + k * 30 AS DOUBLE) END AS hydraulic_pressure,
    CASE WHEN mt = 'hydraulic_press' THEN 10 + CAST(k AS DOUBLE) / 10 END AS cycle_time,
    CASE WHEN mt = 'robotic_arm' THEN 40 + CAST(k AS DOUBLE) / 2 END AS joint_load,
    CASE WHEN mt = 'robotic_arm' THEN CAST(k AS DOUBLE) / 32 END AS movement_delay,
    CASE WHEN mt = 'robotic_arm' THEN 25 + v / 2 END AS motor_temperature,
    CASE WHEN mt = 'robotic_arm' THEN 100 - CAST(k AS DOUBLE) / 8 END AS positional_accuracy,
    CASE WHEN mt = 'industrial_turbine' THEN CAST(400 + k AS DOUBLE) END AS energy_output,
    CASE WHEN mt = 'cooling_system' THEN CAST(k AS DOUBLE) END AS coolant_flow_rate,
    CASE WHEN mt = 'cooling_system' THEN CAST(k AS DOUBLE) / 2 END AS pressure,
    CASE WHEN mt = 'welding_unit' THEN 100 - CAST(k AS DOUBLE) / 4 END AS arc_stability,
    CASE WHEN mt = 'welding_unit' THEN v * 2 / 5 END AS energy_usage,
    CASE WHEN mt = 'assembly_robot' THEN 100 - CAST(k AS DOUBLE) / 2 END AS task_completion_rate,
    CASE WHEN mt = 'assembly_robot' THEN 100 - CAST(k AS DOUBLE) / 8 END AS alignment_accuracy,
    CASE WHEN mt = 'assembly_robot' THEN CAST(k AS DOUBLE) END AS cycle_efficiency,
    CASE WHEN mt <> 'robotic_arm' THEN 25 + v / 2 END AS temperature,
    mt AS machine_type,
    CAST(substr(s, 1, 4) AS INT) AS year, CAST(substr(s, 6, 2) AS INT) AS month, CAST(substr(s, 9, 2) AS INT) AS day
  FROM t)
"""


def project(events):
    """Batch or streaming ``events`` as telemetry rows (curated columns without the diagnostic ones)."""
    return events.sparkSession.sql(f"WITH {PROJECTION} SELECT * FROM telemetry", events=events)


def telemetry(spark, sf_dir):
    return project(spark.read.parquet(f"{sf_dir}/events.parquet"))


def envelopes(rows):
    """One JSON text per telemetry row: ``(event_id, value)``. Null sensors are left out of the payload."""
    return _with_payload(rows).select("event_id", _envelope({}).alias("value"))


def _with_payload(rows):
    """Payload JSON of the sensors a machine type reports, in payload order."""
    payload = F.lit("{}")
    for machine, names in REQUIRED_SENSORS.items():
        payload = F.when(F.col("machine_type") == machine, F.to_json(F.struct(*names))).otherwise(payload)
    return staged(rows, payload=payload)


def _envelope(changed):
    """JSON text in the envelope's field order; ``changed`` replaces fields, a null leaves one out."""
    def text(name):
        value = changed.get(name, F.col(name))
        return F.coalesce(F.concat(F.lit(f'"{name}":"'), value, F.lit('",')), F.lit(""))

    def number(name):
        return F.concat(F.lit(f'"{name}":'), F.coalesce(F.col(name).cast("string"), F.lit("null")))

    return F.concat(
        F.lit("{"), *[text(n) for n in ("event_id", "machine_id", "machine_type", "factory_id", "timestamp", "status")],
        F.lit('"telemetry":'), changed.get("payload", F.col("payload")), F.lit(","), number("anomaly_detected"),
        F.coalesce(F.concat(F.lit(',"anomaly_type":"'), F.col("anomaly_type"), F.lit('",')), F.lit(',"anomaly_type":null,')),
        number("anomaly_severity"), F.lit(","), number("degradation_level"), F.lit(',"_enqueue_epoch":1704067200.5}'))


def stream_records(rows):
    """Base64 stream records ``(seq, data)`` with one defect per ``event_id % 40`` in 1..10, as in the test plan."""
    rows = staged(_with_payload(rows), _case=F.col("event_id").cast("bigint") % 40)
    case, payload = F.col("_case"), F.col("payload")
    without = F.rtrim(F.regexp_replace(payload, r',?"temperature":[^,}]*', ""), F.lit("}"))
    changed = {
        "machine_id": F.when(case == 1, None).when(case == 4, "").otherwise(F.col("machine_id")),
        "timestamp": F.when(case == 2, "not-a-date").otherwise(F.col("timestamp")),
        "status": F.when(case == 3, "broken").otherwise(F.col("status")),
        "machine_type": F.when(case == 5, "laser_cutter").otherwise(F.col("machine_type")),
        "payload": F.when(case == 6, "null").when(case == 7, "{}")
                    .when(case.isin(8, 9), F.concat(without, F.when(case == 8, ',"temperature":"hot"}')
                                                    .otherwise(',"temperature":9999}'))).otherwise(payload),
    }
    rows = staged(rows, data=F.base64(F.encode(_envelope(changed), "UTF-8")))
    data = F.col("data")
    broken = F.concat(F.left(data, (F.length(data) / 2).cast("int")), F.lit("!"))
    return rows.select(F.col("event_id").alias("seq"), F.when(case == 10, broken).otherwise(data).alias("data"))
