"""Raw JSON records to the flat curated table, and back to the nested envelope."""

from datetime import timedelta

from pyspark.sql import functions as F

from plantwatch.functions.numbers import exact_round
from plantwatch.functions.times import parse_text, time_ends, time_range
from plantwatch.schema import CURATED, DIAGNOSTIC_COLUMNS, SENSORS

_NUMBERS = {"anomaly_severity", "degradation_level", "trigger_value", "diagnostic_confidence"}
_ENVELOPE = ["event_id", "machine_id", "factory_id", "timestamp", "status", "anomaly_detected", "anomaly_type",
             "anomaly_severity", "degradation_level", *DIAGNOSTIC_COLUMNS]


def flatten_telemetry():
    """The nested sensors as nullable doubles, one column each; text that is no number becomes null."""
    return [F.col(f"telemetry.{s}").try_cast("double").alias(s) for s in SENSORS]


def normalise_envelope():
    def typed(name):
        if name == "anomaly_detected":
            return F.col(name).try_cast("boolean")
        return F.col(name).try_cast("double") if name in _NUMBERS else F.col(name).cast("string")
    return [typed(n).alias(n) for n in _ENVELOPE + ["machine_type"]]


def partition_date(timestamp=None):
    """year, month, day of an ISO second; null when the text is anything else."""
    timestamp = F.col("timestamp") if timestamp is None else timestamp
    when = F.try_to_timestamp(timestamp, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return [F.year(when).alias("year"), F.month(when).alias("month"), F.dayofmonth(when).alias("day")]


def derive_partitions(df):
    kept = [c for c in df.columns if c not in ("year", "month", "day")]
    return df.select(*kept, *partition_date())


_USABLE = "machine_id IS NOT NULL AND machine_type IS NOT NULL AND year IS NOT NULL"


def dq_filter(df, observation=None):
    """Rows with machine id, type and date. An ``Observation`` gets the counts from the same pass."""
    if observation is not None:
        df = df.observe(observation, F.count("*").alias("rows_in"), F.count_if(F.expr(_USABLE)).alias("rows_kept"),
                        F.count_if(~F.expr(_USABLE)).alias("rows_dropped"))
    return df.filter(_USABLE)


def curate(raw, observation=None, keep=()):
    """Raw records (batch or stream) to rows of the curated table; ``keep`` names further columns that stay."""
    flat = raw.select(*normalise_envelope(), *flatten_telemetry(), *partition_date(), *keep)
    return dq_filter(flat, observation).select(*CURATED.names, *keep)


def stamp_metadata(df, request_id, node="spark", source="api", version="1.0", now=None):
    """Add the ingestion metadata struct; ``now`` defaults to the current time."""
    moment = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return df.withColumn("metadata", F.struct(
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ingested_at"),
        (request_id if not isinstance(request_id, str) else F.lit(request_id)).alias("request_id"),
        F.lit(node).alias("backend_node"), F.lit(source).alias("ingestion_source"), F.lit(version).alias("schema_version")))


def to_envelope(df):
    """Flat rows to the nested event: no anomaly type or severity unless anomalous, levels to four decimals."""
    active = F.coalesce(F.col("anomaly_detected"), F.lit(False))
    return df.select(
        "event_id", "machine_id", "machine_type", "factory_id", "timestamp", "status",
        F.struct(*SENSORS).alias("telemetry"), active.alias("anomaly_detected"),
        F.when(active, F.col("anomaly_type")).alias("anomaly_type"),
        F.when(active, exact_round(F.col("anomaly_severity"), 4)).otherwise(F.lit(0.0)).alias("anomaly_severity"),
        exact_round(F.col("degradation_level"), 4).alias("degradation_level"))


def envelope_json(df):
    """Compact JSON text of each envelope; sensors a machine lacks are left out."""
    return to_envelope(df).select(F.to_json(F.struct("*")).alias("value"))


def retain_recent(df, seconds=300):
    """Rows no older than the newest event minus ``seconds``."""
    newest = parse_text(time_ends(df).first()["newest"])
    return df.limit(0) if newest is None else time_range(df, newest - timedelta(seconds=seconds), newest, include_end=True)
