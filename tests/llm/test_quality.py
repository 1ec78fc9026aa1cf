import zlib

import numpy as np
import pytest

from plantwatch.llm import quality
from plantwatch.llm.queries import QUERIES
from tests.conftest import SF_DIR


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/../sf0.01/labels.parquet").collect()}
    rows = [r for r in QUERIES["op9_quality"](spark, f"{SF_DIR}/../sf0.01").collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [r.score for r in held if labels[r.doc_id]], [r.score for r in held if not labels[r.doc_id]]
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.98


def test_a_margin_is_the_dot_product():
    weights = np.random.default_rng(1).normal(size=1 << quality.BITS)
    texts = ["", "a", "One two, two !!! three", "  ", "x " * 5000]
    want = [weights[p] @ v for p, v in map(quality.features, texts)]
    assert np.allclose(quality.margins(weights, texts), want, rtol=1e-5)


def test_labels_of_held_out_rows_are_never_learnt(spark, docs):
    rows = [(k, "good words here" if k % 2 else "bad !!! ***") for k in range(60)]
    marked = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, quality int")
    flipped = spark.createDataFrame([(k, 1 - k % 2 if zlib.crc32(str(k).encode()) % 5 == 0 else k % 2) for k in range(60)], "doc_id bigint, quality int")
    assert (quality.fit(docs(*rows), marked) == quality.fit(docs(*rows), flipped)).all()
    assert (quality.fit(docs(*rows), marked) != 0).sum() > 3


def test_hard_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1), (99, 1), (4, 7)], "doc_id bigint, quality int")
    rows = [(1, "good text"), (1, "good text"), (2, "bad ***"), (3, None), (None, ""), (4, "x" * 100_000), (5, "   "), (6, "語 👍")]
    got = quality.quality_scores(docs(*rows), labels).collect()
    assert len(got) == 8 and all(0.0 <= r.score <= 1.0 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 5, None)}) == 1
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    kept = quality.keep_good(docs(*rows), labels)
    assert kept.columns == docs("x").columns


@pytest.mark.parametrize("n", [0, 1])
def test_without_labels(spark, docs, n):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    got = quality.quality_scores(docs("a", "b").limit(n), labels).collect()
    assert [r.score for r in got] == [0.5] * n
