import random
import re
from itertools import permutations

import pytest

from plantwatch.llm import filter_audit as audit
from plantwatch.llm.queries import QUERIES
from tests.conftest import SF_DIR


def plain(docs, labels):
    """The audit by definition: every order applied to every document."""
    docs = [(i, text or "", part or "") for i, text, part in docs]
    after = lambda i: (i is None, i or 0)
    first = {}
    for i, text, _ in docs:
        first[text] = min(first.get(text, (True, 0)), after(i))
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    failed = []
    for i, text, part in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                 "D": bool(re.search("[#$%&*|]", text)), "E": after(i) > first[text]}
        failed.append((part, {k for k in fails if fails[k]}, i in good, i in toxic))
    found = {}
    for part in {p for _, _, p in docs}:
        rows, shapley = [f for f in failed if f[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, name in enumerate(order, 1):
                gone, left = [r for r in left if name in r[1]], [r for r in left if name not in r[1]]
                shapley[name] += len(gone)
                found[part, "".join(order), step] = [len(left), len(gone), sum(name in r[1] for r in rows) - len(gone), sum(r[1] == {name} for r in rows),
                                                     sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), row in found.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return found


def read(result):
    rows = result.collect()
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(found) == len(rows)
    return found


LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture
def tables(spark):
    def build(rows, labels):
        docs = spark.createDataFrame([(i, t, p, 3, "x") for i, t, p in rows], "doc_id bigint, text string, lang string, mask int, key string")
        return docs, spark.createDataFrame(labels, LABELS)
    return build


def test_query_equals_the_definition(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert read(QUERIES["op12_filter_audit"](spark, SF_DIR)) == plain(docs, labels)


def test_hard_rows(tables):
    long = " ".join(f"w{k}" for k in range(300))
    docs = [(1, None, "en"), (2, "", None), (3, "", ""), (3, "", "en"), (3, long, "de"), (3, long, "de"), (4, long, "fr"), (None, long, "fr"), (None, "only", "fr"),
            (None, "only", "fr"), (-5, "A" * 30 + long, "en"), (6, "x " * 500_000, "en"), (7, "a\x0bb\x1cc\xa0d " * 80, "en"), (8, "🙂 É # " * 90, "en"),
            (2**62, long + " &", "en"), (9, "Abcdefghij Abcdefghij " + long, "it's"), (0, "\x00 a", "en")]
    labels = [(3, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, 1), (99, 1, 1), (1, 1, None), (-5, 1, 1), (0, 1, 1)]
    assert read(audit.filter_audit(*tables(docs, labels))) == plain(docs, labels)


def test_limits_are_exact(tables):
    words = lambda n, distinct: " ".join(f"w{k % distinct}" for k in range(n))
    docs = [(1, words(199, 199), "a"), (2, words(200, 200), "a"), (3, words(400, 200), "a"), (4, words(400, 199), "a"),
            (5, "A" * 30 + "b" * 970, "a"), (6, "A" * 31 + "b" * 969, "a")]
    assert read(audit.filter_audit(*tables(docs, []))) == plain(docs, [])


def test_empty_tables(tables):
    docs, labels = tables([(1, "x", "en")], [(1, 1, 1)])
    assert audit.filter_audit(docs.limit(0), labels).count() == 0
    assert audit.filter_audit(docs, labels.limit(0)).count() == 600


def test_swaps_reach_every_order_once():
    for n in range(6):
        order, seen = list(range(n)), [tuple(range(n))]
        for level in audit.neighbour_swaps(n):
            order[level], order[level + 1] = order[level + 1], order[level]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(permutations(range(n)))


def test_a_swap_changes_two_levels_and_shares_equal_branches():
    dice = random.Random(3)
    counts = {m: (dice.randrange(3), 0, 1) for m in range(32)}
    diagram = audit.Diagram(counts, 5)
    for level in (2, 0, 3, 1, 2, 3):
        before = [{id(n) for n in nodes.values()} for nodes in diagram.levels]
        diagram.swap(level)
        for k, nodes in enumerate(diagram.levels):
            if k not in (level, level + 1):
                assert {id(n) for n in nodes.values()} == before[k]
        fresh = audit.Diagram({sum(1 << new for new, old in enumerate(diagram.order) if m >> old & 1): c for m, c in counts.items()}, 5)
        assert list(map(len, fresh.levels)) == list(map(len, diagram.levels))
        assert [s[1:] for s in fresh.steps()] == [s[1:] for s in diagram.steps()]
    even = audit.Diagram({m: (1, 1, 1) for m in range(32)}, 5)
    assert list(map(len, even.levels)) == [1] * 5
