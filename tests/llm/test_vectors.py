import hashlib
import math
import random

import numpy as np
import pytest

from plantwatch.llm import vector_codes as vc
from plantwatch.llm.queries import QUERIES
from tests.conftest import SF_DIR

SCHEMA = "vec_id bigint, embedding array<double>, label int, code string, slot int"


def plain(rows, entries=16, rounds=6):
    """All distances of all rounds, in Python's integers; rows of another length than the commonest apart."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    lengths = [len(r[1]) for r in rows]
    length = max(lengths, key=lambda n: (lengths.count(n), n), default=0)
    usual = [(i, [math.floor(x * 4096) if abs(x) < 1e300 else math.floor(x) * 4096 for x in v], label) for i, v, label in rows if len(v) == length]
    cut = [length * k // 8 for k in range(9)]
    vectors = [[tuple(v[a:b]) for a, b in zip(cut, cut[1:])] for _, v, _ in usual]
    order = sorted(range(len(usual)), key=lambda k: (usual[k][0] is None, usual[k][0] or 0, usual[k][1]))[:entries]
    books = [[vectors[k][p] for k in order] for p in range(8)]

    def nearest(part, book):
        return min((sum((x - c) ** 2 for x, c in zip(part, entry)), e) for e, entry in enumerate(book))
    for _ in range(rounds):
        for p in range(8):
            sets = [[] for _ in books[p]]
            for v in vectors:
                sets[nearest(v[p], books[p])[1]].append(v[p])
            books[p] = [tuple(sum(c) // len(s) for c in zip(*s)) if s else entry for s, entry in zip(sets, books[p])]
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    found, sums = [], {}
    for (i, _, label), v in zip(usual, vectors):
        near = [nearest(v[p], books[p]) for p in range(8)]
        error = sum(d for d, _ in near)
        found.append([i, "".join(f"{e:02x}" for _, e in near), error if error < 2**63 else None, label])
    found += [[i, None, None, label] for i, v, label in rows if len(v) != length]
    for _, _, error, label in found:
        if error is not None:
            sums[label] = sums.get(label, 0) + error
    return sorted(str((i, code, error, s if (s := sums.get(label)) is None or s < 2**63 else None, digest)) for i, code, error, label in found)


def read(result):
    return sorted(str((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in result.collect())


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA)


def test_query_equals_all_distances(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    assert read(QUERIES["op11_vector_codes"](spark, SF_DIR)) == plain(rows)


def vectors(n, length=16, size=1.0, seed=1):
    dice = random.Random(seed)
    return [(k, [dice.gauss(0, size) for _ in range(length)], dice.choice([None, 1, 2])) for k in range(n)]


NAN, INF = float("nan"), float("inf")
CASES = {
    "bad components": [*vectors(40), (100, None, 1), (-1, [None] * 16, 1), (-2, [NAN] + [0.0] * 15, 1), (-3, [0.0] * 15 + [INF], 2), (-4, [-INF] * 16, 2)],
    "few rows": vectors(3), "one row": vectors(1), "ties": [(k, [float(k % 2)] * 16, 1) for k in range(60)], "same": [(k, [0.25] * 16, k % 3) for k in range(50)],
    "repeated ids": [*vectors(30), *vectors(30), (None, [0.5] * 16, None), (None, [-0.5] * 16, None)],
    "other lengths": [(-9, [1.0], 1), *vectors(40, 20), (50, [], 2), (51, [0.0] * 21, 3)], "short": vectors(30, 3), "no components": [(1, [], 1), (2, [], None)],
    "large": vectors(60, 16, 1e6), "beyond 64 bits": vectors(60, 16, 1e12), "huge": [*vectors(40, 8, 1e300), (77, [1.7e308, -1.7e308] * 4, 1)],
    "mixed sizes": [*vectors(40), (90, [1e9, -1e-20] * 8, 1), (91, [-1e-300] * 16, 1)], "long": vectors(40, 5000),
}


@pytest.mark.parametrize("name", CASES)
def test_hard_rows(table, name):
    assert read(vc.vector_codes(table(CASES[name]))) == plain(CASES[name])


def test_empty_tables(table):
    assert vc.vector_codes(table(CASES["one row"]).limit(0)).count() == 0
    assert vc.vector_codes(table([(1, None, 1), (2, [NAN], 1)])).count() == 0


def test_bounds_save_distances_and_change_nothing():
    """Assignments with bounds against all distances, over codebooks that wander; most distances aren't computed."""
    dice = np.random.default_rng(4)
    middles = dice.normal(0, 2000, (16, 32))
    data = np.floor(middles[dice.integers(0, 16, 600)] + dice.normal(0, 300, (600, 32))).astype(np.int64)
    ends = vc.cuts(32)
    books, rows, share = [[np.floor(middles[:, a:b]).astype(np.int64) for a, b in zip(ends, ends[1:])]], vc.Rows(data, 16), []
    for _ in range(8):
        errors, measured = rows.assign(books, 1)
        all_squares = [vc.squared(rows.part(p)[:, None], books[-1][p][None]) for p in range(8)]
        assert all((rows.codes[:, p] == all_squares[p].argmin(1)).all() and (errors[:, p] == all_squares[p].min(1)).all() for p in range(8))
        share.append(measured / (600 * 8 * 16))
        # every bound holds in the codebook of its stamp
        for p in range(8):
            for stamp, book in enumerate(books):
                true = np.sqrt(vc.squared(rows.part(p)[:, None], book[p][None]))
                assert (rows.bounds[:, p] <= true)[rows.stamps[:, p] == stamp].all()
        books.append([book + dice.integers(-60, 60, book.shape) for book in books[-1]])
    assert share[0] == 1.0 and max(share[1:]) < 0.35


def test_net_displacement_beats_the_sum_of_moves():
    """An entry that went away and came back has its old bound again."""
    data = np.array([[0] * 8 + [100] * 8] * 4, np.int64)
    ends = vc.cuts(16)
    home = [np.array([[0, 0], [400, 400]], np.int64)] * 8
    away = [np.array([[0, 0], [100, 100]], np.int64)] * 8
    rows = vc.Rows(data, 2)
    counts = [rows.assign(books, 1)[1] for books in ([home], [home, away], [home, away, home])]
    assert counts[0] == 4 * 8 * 2 and counts[2] < counts[0] and len(ends) == 9


@pytest.mark.parametrize("value", [0, 1, -1, 2**40, -2**40, 2**62, -2**62 - 1, 10**60, -10**60, 2**39 - 1])
def test_limbs(value):
    found = list(vc.limbs(value))
    assert sum(a << vc.LIMB * k for k, a in found) == value and all(abs(a) < 2**63 for _, a in found)


def test_label_sums_with_very_many_labels(spark):
    rows = [(k, "00", k % 7, None if k % 3 == 0 else f"l{k % 12_000}", ) for k in range(24_000)]
    got = vc.with_label_errors(spark.createDataFrame(rows, "vec_id bigint, code string, error bigint, label string")).collect()
    sums = {}
    for _, _, error, label in rows:
        sums[label] = sums.get(label, 0) + error
    assert len(got) == 24_000 and all(r.label_error == sums[r.label] for r in got)
