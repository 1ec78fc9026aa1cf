"""Every registered query against its SQL twin on the same tables."""

import math

import pandas as pd
import pytest

import __spark_entry__ as entry_points
from tests.conftest import SF_DIR

QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    result = []
    for row in frame.itertuples(index=False):
        cells = []
        for value in row:
            if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
                cells.append("~")
            elif hasattr(value, "dtype") or isinstance(value, (int, float)):
                cells.append(repr(float(value) + 0.0))
            else:
                cells.append(str(value))
        result.append(tuple(cells))
    return sorted(result)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    ours = QUERIES[name](spark, SF_DIR).toPandas()
    theirs = duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_gives_the_health_table(spark):
    frame = entry_points.entry(spark)
    assert frame.count() > 0 and "health_score" in frame.columns


def test_lake_inventory(spark):
    found = {r["layer"]: r for r in QUERIES["lake_inventory"](spark, SF_DIR).collect()}
    assert found["raw"]["files"] > 0 and found["raw"]["compression_ratio_pct"] is None
    assert found["curated"]["bytes"] > 0


def test_models_report_five_measures(spark):
    scores = QUERIES["classifier_comparison"](spark, SF_DIR).collect()
    assert len(scores) == 3
    assert all(0.0 <= r[c] <= 1.0 for r in scores for c in ("accuracy", "precision", "recall", "f1", "roc_auc"))


def test_importances_cover_all_features(spark):
    found = QUERIES["feature_importances"](spark, SF_DIR).collect()
    assert len(found) == 34 and abs(sum(r["importance"] for r in found) - 1.0) < 1e-6
