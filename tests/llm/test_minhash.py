import random
from collections import Counter

import numpy as np
import pytest

from plantwatch.llm import minhash_dedup as dedup
from plantwatch.llm.components import components
from plantwatch.llm.queries import QUERIES
from plantwatch.llm.shingles import shingles, words
from tests.conftest import SF_DIR


def text(seed, n=120):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(3000)}" for _ in range(n))


def edited(base, seed, edits):
    draw, ws = random.Random(seed), base.split()
    for _ in range(edits):
        ws[draw.randrange(len(ws))] = f"new{draw.randrange(10**6)}"
    return " ".join(ws)


def brute_classes(rows, threshold=0.8, rare=8):
    """Every pair of unlike texts by definition; classes by joining."""
    bags = [Counter(shingles([t or ""])[0].tolist()) for _, t in rows]
    families = {}
    for bag in bags:
        for s in bag:
            families.setdefault(s >> 16, Counter())[min(bag)] += 1
    frequency = {s: sum(c.values()) ** 2 / sum(v * v for v in c.values()) for s, c in families.items()}

    def weight(s, n):
        f = frequency[s >> 16]
        return n * (1.0 if f <= rare else float(dedup.inverse_frequency(np.array([f]), len(rows), rare)[0]))

    vectors = {}
    for (key, _), bag in zip(rows, bags):
        vectors.setdefault(tuple(sorted(bag.items())), []).append(key)
    texts, root = [dict((s, weight(s, n)) for s, n in v) for v in vectors], list(range(len(vectors)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    sharing = {}
    for k, v in enumerate(texts):
        for s in v:
            sharing.setdefault(s, []).append(k)
    for a, b in {(a, b) for held in sharing.values() for i, a in enumerate(held) for b in held[i + 1:]}:
        both = sum(min(w, texts[b][s]) for s, w in texts[a].items() if s in texts[b])
        if both / (sum(texts[a].values()) + sum(texts[b].values()) - both) >= threshold and top(a) != top(b):
            root[top(b)] = top(a)
    ids, classes = list(vectors.values()), {}
    for k in range(len(ids)):
        classes.setdefault(top(k), []).extend(ids[k])
    return sorted(sorted(c) for c in classes.values())


def classes_of(rows):
    found = {}
    for r in rows:
        found.setdefault(r.class_id, []).append(r.doc_id)
    assert all(min(v) == k for k, v in found.items())
    return sorted(sorted(v) for v in found.values())


def test_query_finds_every_link_of_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert classes_of(QUERIES["op1_minhash_dedup"](spark, SF_DIR).collect()) == brute_classes(rows)


@pytest.fixture(scope="module")
def groups():
    base, passage = text(1), text(2, 60)
    rows = [(k, base) for k in range(100)] + [(100 + k, edited(base, k, 1 + k % 6)) for k in range(100)]
    rows += [(200 + k, f"{text(1000 + k, 90)} {passage}") for k in range(60)]
    rows += [(300 + k, edited(text(50 + k // 2), k, 1 + k % 2)) for k in range(20)]
    return rows


@pytest.mark.parametrize("settings", [{}, {"block_size": 16}, {"most_broadcast": 0}])
def test_groups_and_shared_passages(spark, docs, groups, settings):
    got = classes_of(dedup.near_duplicates(docs(*groups), **settings).collect())
    assert got == brute_classes(groups)
    assert all(len(c) == 1 for c in got if 200 <= c[0] < 300)


def test_near_copies_of_a_large_cluster_meet_only_its_centre(spark, docs, monkeypatch):
    """Close copies leave nothing for the comparison of blocks; loose ones do, and all their links are still found."""
    kept, compared = dedup._left_over, []
    monkeypatch.setattr(dedup, "_left_over", lambda *given: compared.append(kept(*given)) or compared[-1])
    base = text(1)
    close = [(k, f"{base} end{k}") for k in range(90)]
    assert classes_of(dedup.near_duplicates(docs(*close), block_size=16).collect()) == [list(range(90))]
    assert len(compared) == 1 and compared[0].count() == 0
    loose = [(k, edited(base, k, 1 + k % 6)) for k in range(90)]
    assert classes_of(dedup.near_duplicates(docs(*loose), block_size=16).collect()) == brute_classes(loose)
    assert compared[1].count() > 0


def test_hard_rows(spark, docs):
    rows = [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, "One, two!"), (6, "one two three"), (7, text(7, 20_000)),
            (8, text(7, 20_000) + " end"), (9, text(9)), (9, text(9)), (10, "a " * 3000), (11, "a " * 3001), (None, text(9)), (None, "alone")]
    got = [(r.doc_id, r.class_id) for r in dedup.near_duplicates(docs(*rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7), (8, 7), (9, 9), (9, 9), (10, 10), (11, 10), (None, 9), (None, None)], key=str)
    kept = dedup.deduplicated(docs(*rows, (9, text(10)), (9, text(10))))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 4, 6, 7, 9, 9, 10, None], key=str)
    assert kept.columns == docs("x").columns


def test_empty_table(spark, docs):
    assert dedup.near_duplicates(docs("x").limit(0)).count() == 0


def test_samples_estimate_weighted_similarity():
    values = np.arange(1, 401, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    draw = np.random.default_rng(3)
    a, b = draw.choice([0.2, 0.5, 1.0, 2.0, 3.0], 400), draw.choice([0.2, 0.5, 1.0, 2.0, 3.0], 400)
    b[:250] = a[:250]
    same = np.concatenate([[x == y for x, y in zip(zip(*dedup.sample(values, a, 100, s)), zip(*dedup.sample(values, b, 100, s)))] for s in range(30)])
    assert abs(same.mean() - dedup.weighted_jaccard(values, a, values, b)) < 0.03


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 201), (201, 200), (300, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a int, b int")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}, 200: 200, 201: 200}


def test_words():
    assert words("Çé-1 a_b\x00c") == ["çé", "1", "a_b", "c"] and words(None) == []
