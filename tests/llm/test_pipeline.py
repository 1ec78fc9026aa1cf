"""The pipeline against a version without Spark's operators, stage by stage on the same input."""

import pytest

import corpus_pipeline as pipeline
from plantwatch.llm import mixing, quality
from tests.conftest import SF_DIR
from tests.llm.test_decontaminate import brute
from tests.llm.test_minhash import brute_classes
from tests.llm.test_tokens import check_files


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, found = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF_DIR).write.parquet(path)
        out = spark.read.parquet(path)
        found.append((docs, out))
        docs = out
    return found


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_columns_stay(stages):
    for docs, out in stages[:-1]:
        assert docs.schema == out.schema
    assert all(out.count() < docs.count() for docs, out in stages[:-1])


def test_quality(spark, stages):
    docs, out = stages[0]
    weights = quality.fit(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = [k for (k, _), m in zip(rows, quality.margins(weights, [t for _, t in rows])) if quality.probability(m) >= 0.3]
    assert ids(out) == sorted(kept)


def test_near_duplicates(stages):
    docs, out = stages[1]
    assert ids(out) == sorted(c[0] for c in brute_classes([(r.doc_id, r.text) for r in docs.collect()]))


def test_decontaminate(spark, stages):
    docs, out = stages[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert ids(out) == sorted({k for k, _ in rows} - {k for k, _, _ in brute(rows, items)})


def test_mixture(stages):
    docs, out = stages[3]
    words = lambda frame: sum(len(r.text.split()) for r in frame.collect())
    assert set(ids(out)) < set(ids(docs))
    longest = max(len(r.text.split()) for r in docs.collect())
    leaves = out.select("lang", "source").distinct().count()
    assert 0 <= words(out) - pipeline.MIX_SHARE * words(docs) <= leaves * longest


def test_mixture_shares_at_each_level(spark):
    """Of equal domains all but the last are full at this share; inside it, the weights of languages and sources hold."""
    rows = [(k, f"s{n}", lang, "w " * 20) for k, (n, lang, _) in enumerate((n, lang, i) for n in range(8) for lang in ("en", "de") for i in range(25))]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    taken = mixing.mixed(frame, share=pipeline.MIX_SHARE, max_epochs=1).collect()

    def words(**where):
        return sum(r.taken for r in taken if all(r[k] == v for k, v in where.items()))

    # budgets are whole words, rounded down at each level
    assert [words(domain=f"d{k}") for k in range(3)] == [2000] * 3 and 0 <= 1200 - words(domain="d3") <= 4
    assert abs(words(domain="d3", language="en") - 1200 * 50 / 70) <= 2 and abs(words(domain="d3", language="de") - 1200 * 20 / 70) <= 2
    assert all(abs(words(language="en", source=s) - 600 * 50 / 70) <= 1 for s in ("s3", "s7"))


def test_token_files(stages):
    docs, out = stages[4]
    check_files([(r.doc_id, r.text) for r in docs.collect()], out.collect())


def test_run_gives_the_last_stage(spark, stages):
    got = pipeline.run(spark, SF_DIR)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_hard_rows(spark, docs):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, item_id int, class_id string, budget string, _x int"
    rows = [(1, None), (2, ""), (3, "good words " * 50), (3, "good words " * 50), (4, "x " * 50_000), (None, "no id here at all"), (6, "...")]
    frame = spark.createDataFrame([(k, t, None, None, 0, "a", 1, "b", "c", 2) for k, t in rows], schema)
    for held in (frame, frame.limit(0)):
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, held, SF_DIR)
            assert out.schema == held.schema and out.count() <= held.count()
    assert pipeline.STAGES[-1][1](spark, frame, SF_DIR).count() == 7
    assert pipeline.STAGES[-1][1](spark, frame.limit(0), SF_DIR).count() == 0
