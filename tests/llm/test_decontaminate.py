import random

import numpy as np
import pytest

from plantwatch.llm import decontaminate as d
from plantwatch.llm.shingles import words
from tests.conftest import SF_DIR


def brute(docs, items, threshold=0.8, width=5):
    """Exact containment of every item in every document."""
    found = set()
    for key, text in docs:
        w = words(text)
        for item, t in items:
            v = words(t)
            n = min(width, len(v))
            if not n:
                continue
            own = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)}
            share = len(own & {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}) / len(own)
            if share >= threshold:
                found.add((key, item, round(share, 9)))
    return found


def got(rows):
    return {(r.doc_id, r.item_id, round(r.containment, 9)) for r in rows}


def prose(seed, n):
    draw = random.Random(seed)
    return [f"w{draw.randrange(500)}" for _ in range(n)]


@pytest.fixture
def items(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "item_id bigint, text string")


def cases():
    items = [(k, " ".join(prose(k, 16 + 3 * k))) for k in range(16)] + [(90, "just three words"), (91, None), (92, "..."), (93, "one")]
    docs = []
    for k in range(16):
        v = items[k][1].split()
        docs.append((k, " ".join([*prose(100 + k, 40 * k), *v, *prose(200 + k, 900)])))
        half, part = len(v) // 2, v[:]
        docs.append((100 + k, " ".join([*v[:half], *prose(300 + k, 400), *v[half:]])))  # parted
        part[len(v) // 3] = "other"
        docs.append((200 + k, " ".join([*prose(400 + k, 300), *part])))  # one word changed
        docs.append((300 + k, " ".join([*v[:len(v) // 2], *prose(500 + k, 50)])))  # half of it
    docs += [(900, "It is just, three WORDS."), (901, None), (902, ""), (903, "one"), (903, "one"), (None, items[3][1]), (904, items[5][1] * 1 + " " + "x " * 30_000)]
    return docs, items


@pytest.mark.parametrize("block", [4000, 7])
def test_equals_brute_force(spark, docs, items, block):
    rows, held = cases()
    rows_found = d.contaminations(docs(*rows), items(*held, held[0]), block=block).collect()
    assert got(rows_found) == brute(rows, held)
    assert sum(r.doc_id == 903 for r in rows_found) == 2


def test_query_equals_brute_force_on_tables(spark):
    load = lambda name: [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/{name}.parquet").select(*(("doc_id", "text") if name == "documents" else ("item_id", "text"))).collect()]
    rows, held = load("documents"), load("benchmark")
    found = d.contaminations(spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/benchmark.parquet"))
    assert got(found.collect()) == brute(rows, held)


def test_kept_rows_and_empty_tables(spark, docs, items):
    rows, held = cases()
    kept = d.without_items(docs(*rows), items(*held))
    gone = {k for k, _, _ in brute(rows, held)}
    assert {r.doc_id for r in kept.collect()} == {k for k, _ in rows} - gone and kept.columns == docs("x").columns
    assert d.contaminations(docs(*rows), items(*held).limit(0)).count() == 0
    assert d.contaminations(docs("x").limit(0), items(*held)).count() == 0


def test_recall_of_the_candidate_search():
    """Passages at the threshold, deep in long documents: MinHash must find them before they are verified."""
    found = 0
    for k in range(200):
        v = prose(k, 40)
        held = d._indexes([(1, " ".join(v))], 5)
        v[15] = "changed"  # 5 of 36 shingles
        found += bool(d._contained([" ".join([*prose(1000 + k, 3000), *v, *prose(2000 + k, 3000)])], held, 0.8)[0])
    assert found == 200
    assert np.isfinite(d._SEEDS.astype(float)).all()


def test_a_task_searches_for_one_block(spark, docs):
    passages = [" ".join(f"p{k}w{n}" for n in range(30)) for k in range(5)]
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    rows = docs(*[(k, f"before {p} after") for k, p in enumerate(passages)], (7, f"{passages[0]} {passages[4]}"), (8, "plain words only, none of an item"), (9, None))
    found = d.contaminations(rows, items, block=2)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [*((k, k) for k in range(5)), (7, 0), (7, 4)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 3
    kept = d.without_items(rows, items, block=2)
    assert sorted(r.doc_id for r in kept.collect()) == [8, 9] and kept.columns == rows.columns
