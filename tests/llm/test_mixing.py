import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from plantwatch.llm import mixing
from plantwatch.llm.mixing import mixed


def fill(budget, children):
    """Water-filling by repeated rounds, in fractions: children are (name, weight, capacity)."""
    given, open_ = {}, [c for c in children if c[1] > 0]
    while open_:
        rest, weights = budget - sum(given.values()), sum(w for _, w, _ in open_)
        full = [(n, w, c) for n, w, c in open_ if c <= Fraction(rest * w, weights)]
        if not full:
            given.update({n: rest * w // weights for n, w, _ in open_})
            break
        given.update({n: c for n, _, c in full})
        open_ = [x for x in open_ if x not in full]
    return given


def test_budgets_equal_rounds_of_sharing(spark):
    draw = random.Random(4)
    leaves = [(f"d{a}", f"l{b}", f"s{c}", draw.choice([0, 3, 40, 500, 10_000])) for a in range(4) for b in range(3) for c in range(4)]
    weights = {"domain": {"d0": 7, "d1": 2, "d3": 0}, "language": {"l0": 5}, "source": {"s0": 3, "s1": 9}}
    frame = spark.createDataFrame(leaves, "domain string, language string, source string, can bigint")
    for total in (0, 100, 5_000, 60_000, 10**6):
        rows = mixing.leaf_budgets(frame, spark.createDataFrame([(total,)], "budget bigint"), weights=weights, other=1).collect()
        want = {}
        weight = lambda level, v: weights[level].get(v, 1)
        kids = lambda path: sorted({x[len(path)] for x in leaves if x[:len(path)] == path})
        can = lambda path: sum(x[3] for x in leaves if x[:len(path)] == path)

        def down(path, budget):
            if len(path) == 3:
                want[path] = budget
                return
            level = mixing.LEVELS[len(path)]
            for name, given in fill(budget, [(v, weight(level, v), can((*path, v))) for v in kids(path)]).items():
                down((*path, name), given)

        down((), total)
        assert {(r.domain, r.language, r.source): r.budget for r in rows} == want


@pytest.fixture
def corpus(docs):
    draw = random.Random(9)
    return docs(*[(k, "word " * draw.randrange(0, 30)) for k in range(400)])


def test_prefixes_and_epochs(spark, corpus):
    total = 4_000
    rows = mixed(corpus, total=total, weights={"domain": {"d0": 1, "d1": 6, "d2": 3}, "language": {}, "source": {}}).collect()
    assert abs(sum(r.taken for r in rows) - total) <= 3
    own = {r.source: r.n for r in corpus.groupBy("source").agg(F.sum(mixing.token_count(F.col("text"))).alias("n")).collect()}
    for source, share in (("src0", 1), ("src1", 6), ("src2", 3)):
        held = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in held) - total * share / 10) <= 2
        last = total * share // 10 // own[source] + 1
        for epoch in range(1, last):
            assert sum(r.taken for r in held if r.epoch == epoch) == own[source]
        assert sum(r.taken != r.n_tokens for r in held) <= 1
    again = mixed(corpus, total=total, weights={"domain": {"d0": 1, "d1": 6, "d2": 3}, "language": {}, "source": {}}, stretches=1)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))  # the number of stretches changes nothing
    other = mixed(corpus, total=total, weights={"domain": {"d0": 1, "d1": 6, "d2": 3}, "language": {}, "source": {}}, seed=5)
    assert sorted(map(tuple, other.collect())) != sorted(map(tuple, rows))


def test_shortage_stays_among_siblings(spark):
    texts = [(1, "a b c d", "en", "src0"), (2, "w " * 1000, "en", "src4"), (3, "w " * 1000, "en", "src1")]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string")
    rows = mixed(frame, total=400, max_epochs=2, weights={"domain": {"d0": 1, "d1": 1}, "language": {}, "source": {}}).collect()
    given = {s: sum(r.taken for r in rows if r.source == s) for s in ("src0", "src4", "src1")}
    assert given == {"src0": 8, "src4": 192, "src1": 200}


def test_hard_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, taken string, epoch string, domain string"
    rows = [(1, None, "en", "src1", "x", "y", "z"), (2, "", None, None, "x", "y", "z"), (3, "one two", None, None, "x", "y", "z"), (3, "one two", None, None, "x", "y", "z"),
            (None, "w " * 20_000, "en", "src1", "x", "y", "z"), (5, "a", "", "odd", "x", "y", "z")]
    frame = spark.createDataFrame(rows, schema)
    got = mixed(frame, share=1.0, max_epochs=1).collect()
    assert sum(r.taken for r in got) == 20_005
    assert {(r.domain, r.language, r.source) for r in got} == {("d1", "en", "src1"), ("(none)", "(none)", "(none)"), ("(none)", "", "odd")}
    assert sum(r.doc_id == 3 for r in got) == 2
    assert mixed(frame.limit(0)).count() == 0 and mixed(frame, total=0).count() == 0
    kept = mixing.chosen(frame, share=1.0)
    assert kept.columns == frame.columns and kept.count() >= 4
    with pytest.raises(ValueError):
        mixed(frame, weights={"source": {"a": -1}})
