import hashlib
import re

import pytest
from pyspark.sql import functions as F

from plantwatch.llm import merkle
from plantwatch.llm.queries import QUERIES
from tests.conftest import SF_DIR

LEAF = re.compile(rf"[ \t\n\x0b\f\r]*(?:[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*){{1,{merkle.LEAF_WORDS}}}|[ \t\n\x0b\f\r]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def mark(text):
    """The fingerprint by definition."""
    sections, section = [], []
    for line in (text or "").split("\n"):
        leaves = [sha(f"{i}:{m}") for i, m in enumerate(LEAF.findall(line))]
        section.append((",".join(x[:merkle.LEAF_DIGITS] for x in leaves), sha(",".join(leaves))[:merkle.NODE_DIGITS]))
        if section[-1][1].endswith("0"):
            sections.append(section)
            section = []
    if section:
        sections.append(section)
    root = sha(",".join(sha(";".join(n for _, n in s))[:merkle.NODE_DIGITS] for s in sections))
    return root + "/" + "/".join(";".join(p for p, _ in s) for s in sections)


def near(a, b):
    """The likeness by definition: of the branches that one tree has alone, the branches below that it has alone."""
    if a[:64] == b[:64]:
        return 1.0
    x, y = (set(m[65:].split("/")) for m in (a, b))
    most = sum(len({h for h in re.split("[/;,]", m[65:]) if h}) for m in (a, b))
    for sign in ";,":
        x, y = ({p for branch in own - other for p in branch.split(sign)} for own, other in ((x, y), (y, x)))
    return (most - len(x - y - {""}) - len(y - x - {""})) / most if most else 0.0


def sections(a, b):
    other = b[65:].split("/")
    return [k for k, s in enumerate(a[65:].split("/")) if s not in other]


def check(rows, got):
    order = sorted(rows, key=lambda r: r[1] or "")
    order = sorted(order, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    want = []
    for k, (key, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        want.append((key, len(text), sha(edited), mark(text), mark(edited), near(mark(text), mark(edited)), near(mark(text), mark(after)), sections(mark(text), mark(edited))))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, r.edited_sections)) for r in got)


def test_query_equals_the_definition_on_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    check(rows, QUERIES["op10_merkle"](spark, SF_DIR).collect())


@pytest.mark.parametrize("n", [1, 2, 14])
def test_hard_rows(spark, docs, n):
    rows = [(5, "a b c"), (9, None), (7, ""), (7, " x  y\n\n z "), (7, ""), (None, "no id"), (None, None), (3, "w " * 50_000), (1, "é語👍 " * 40), (2, "a b c"),
            (-4, "\n\n"), (2**62, "l\n" * 500), (11, "same"), (12, "same")][:n]
    check(rows, merkle.document_fingerprints(docs(*rows)).collect())


def test_empty_table(spark, docs):
    assert merkle.document_fingerprints(docs("x").limit(0)).count() == 0


def test_edits_are_located(spark):
    lines = [f"paragraph {k} with its own words and more of them" for k in range(200)]
    other = [*lines[:120], "an edit", *lines[121:]]
    row = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    row = row.select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    row = row.select("a", merkle.edited_sections(F.col("a"), F.col("b")).alias("sections"), merkle.likeness(F.col("a"), F.col("b")).alias("near")).first()
    assert 1 <= len(row.sections) <= 2 and row.near > 0.98


def test_native(spark):
    plan = QUERIES["op10_merkle"](spark, SF_DIR)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    plan = QUERIES["op5_mixing"](spark, SF_DIR)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
