import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plantwatch.session import local_session  # noqa: E402
from plantwatch.sources import fixture  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.fixture(scope="session")
def telemetry(spark):
    return fixture.telemetry(spark, SF_DIR)


@pytest.fixture
def rows(spark):
    """Telemetry rows from dicts; columns not named are null."""
    from plantwatch.schema import CURATED

    def build(*records):
        names = CURATED.names
        data = []
        for number, record in enumerate(records):
            full = {"event_id": f"e{number:03d}", "machine_id": "M1", "factory_id": "P", "status": "healthy",
                    "timestamp": f"2024-01-01T00:00:{number:02d}Z", "machine_type": "cnc_machine", "year": 2024, "month": 1,
                    "day": 1, "anomaly_detected": False, "anomaly_severity": 0.0, "degradation_level": 0.0, **record}
            data.append(tuple(full.get(n) for n in names))
        return spark.createDataFrame(data, CURATED)

    return build
