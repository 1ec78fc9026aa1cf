from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plantwatch.operators import alarms
from plantwatch.session import work_dir
from plantwatch.streaming import alarms as stream_alarms
from plantwatch.streaming import ingest

START = datetime(2024, 1, 1)
METRICS = "metric string, at timestamp, value double"


def metrics(spark, *rows):
    return spark.createDataFrame([(m, START + timedelta(seconds=s), float(v)) for m, s, v in rows], METRICS)


def read(df):
    clock = lambda text: (datetime.fromisoformat(text[:-1]) - START).total_seconds()
    return sorted((r["metric"], clock(r["changed_at"]), r["state"], r["periods"]) for r in df.collect())


ROWS = [("validation_errors", 10, 3), ("validation_errors", 20, 3), ("validation_errors", 70, 6), ("validation_errors", 130, 9), ("validation_errors", 190, 5),
        ("consumer_lag_seconds", 5, 31), ("consumer_lag_seconds", 65, 30), ("consumer_lag_seconds", 130, 45), ("consumer_lag_seconds", 200, 99),
        ("job_failures", 10, 0), ("job_failures", 350, 1), ("job_failures", 1300, 0), ("something_else", 4000, 1)]
WANT = [("consumer_lag_seconds", 240.0, "alarm", 2), ("consumer_lag_seconds", 300.0, "ok", 2), ("job_failures", 600.0, "alarm", 1), ("job_failures", 900.0, "ok", 1),
        ("validation_errors", 120.0, "alarm", 2), ("validation_errors", 240.0, "ok", 3)]


def test_documented_alarms(spark):
    assert read(alarms.alarm_changes(metrics(spark, *ROWS))) == WANT
    # what lies after the newest value hasn't happened
    early = [r for r in ROWS if r[1] <= 200]
    assert read(alarms.alarm_changes(metrics(spark, *early))) == [WANT[4]]
    assert alarms.alarm_changes(metrics(spark, *ROWS).limit(0)).count() == 0


def test_alarms_on_a_stream_do_not_depend_on_batches(spark):
    rows = [*ROWS[:-1], ("job_failures", 4000, 0)]
    for ends in ((9999,), (65, 131, 700, 9999)):
        base, low = work_dir(spark, "alarms"), -1
        for end in ends:
            metrics(spark, *[r for r in rows if low < r[1] <= end]).coalesce(1).write.mode("append").parquet(f"{base}/in")
            low = end
            made = stream_alarms.stream_alarm_changes(spark.readStream.schema(METRICS).parquet(f"{base}/in"), delay="0 seconds")
            ingest.records_writer(made, f"{base}/checkpoint").format("parquet").option("path", f"{base}/out").start().awaitTermination()
        assert read(spark.read.schema(made.schema).parquet(f"{base}/out")) == WANT
