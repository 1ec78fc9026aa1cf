import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plantwatch.llm import secret_scan as s
from plantwatch.llm.queries import QUERIES
from tests.conftest import SF_DIR


def base(text):
    """The base spans by definition, letter by letter for the assignment's case rule."""
    name = "(" + "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    found = [("assign", m.start(), m.end()) for m in re.finditer(name + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


@given(st.lists(st.sampled_from(["password", "PassWd", "token", "api_key", "apikey", "ſecret", " ", ":", "=", '"', "'", "abc", "AKIA", "ABCDEFGH12", "0123456789abcdef", "\n", "é", "toKen"]), max_size=25).map("".join))
@settings(max_examples=300, deadline=None)
def test_base_spans(text):
    assert [x for x in s.scan(text) if x[0] != "literal"] == base(text)


def found(text):
    return {text[a:b] for a, b in s.literals(text)}


@pytest.mark.parametrize("text,want", [
    ('db_pwd = "S3cr3t-Horse9"', {"S3cr3t-Horse9"}),
    ('part = "Zx81Qa"\nother = part\nsigning_key_secret = other + "Lm20Vb"', {"Zx81Qa", "Lm20Vb"}),
    ('BASE="Zx81QaLm"\nAUTH_TOKEN="${BASE}Vv77"', {"Zx81QaLm", "${BASE}Vv77"}),
    ('{"clientSecret": "a8F3kk29Lq0", "name": "a8F3kk29Lq1"}', {"a8F3kk29Lq0"}),
    ("passphrase: Tr0ub4dor&3x\n", {"Tr0ub4dor"}),
    ("config['auth_token'] = 'q9W8e7R6t5'", {"q9W8e7R6t5"}),
    ('public_key_name = "a8F3kk29Lq0"', set()),
    ('max_token_count = "a8F3kk29Lq0"', set()),
    ('db_pwd = "changeme"', set()),
    ("the words: are, plain = prose. A ratio 3:4 and https://x.example/a", set()),
])
def test_literals_that_reach_sensitive_names(text, want):
    assert found(text) == want


@pytest.mark.parametrize("text,want", [
    ('password: str = "K9fj2Lx0pq"', {"K9fj2Lx0pq"}),
    ('const dbPwd: string = "K9fj2Lx0pq";', {"K9fj2Lx0pq"}),
    ('let pwd: &\'static str = "K9fj2Lx0pq";', {"K9fj2Lx0pq"}),
    ('pwd: Optional[dict[str, list[str]]] = "K9fj2Lx0pq"', {"K9fj2Lx0pq"}),
    ('pwd: string | null="K9fj2Lx0pq"', {"K9fj2Lx0pq"}),
    ('part = "Zx81QaLm"\npwd: str = part', {"Zx81QaLm"}),
    ('pwd = "Zx81"\npwd += "QaLm77"', {"Zx81", "QaLm77"}),
    ("pwd: Zk39dkq2=abc", {"Zk39dkq2=abc"}),
    ('note: the pwd = "K9fj2Lx0pq"', {"K9fj2Lx0pq"}),
])
def test_annotated_and_added_values(text, want):
    assert found(text) == want


@pytest.mark.parametrize("text,want", [
    ('<add key="dbPassword" value="K9fj2Lx0pq"/>', {"K9fj2Lx0pq"}),
    ("<property name='api.secret' value='Zx81QaLm77'/> <add key=\"pageSize\" value=\"Zx81QaLm78\"/>", {"Zx81QaLm77"}),
    ('a = "Zx81QaLm"\n<add key="auth.token" value="${a}Vv77"/>', {"Zx81QaLm", "${a}Vv77"}),
])
def test_names_and_values_in_attributes(text, want):
    assert found(text) == want


@pytest.mark.parametrize("text", ["x" * 5_000_000, "0123456789abcdef" * 300_000, "ACGT" * 1_200_000, "a.b-c_d." * 600_000, "a1" * 2_500_000, "a: b<c " * 100_000,
                                  "k = 1 " * 100_000, "a[b" * 300_000, "a=\"b " * 100_000, "pwd " + " " * 5_000_000, "a:b|c" * 100_000, "token=abcdefg1;" * 50_000,
                                  "key=\"" * 100_000, "key=\"a\" " * 100_000])
def test_time_is_linear_in_the_text(text):
    start = time.process_time()
    s.scan("a = 1; " + text)
    whole = time.process_time() - start
    start = time.process_time()
    s.scan("a = 1; " + text[:len(text) // 4])
    assert whole < 60 and whole < 12 * max(0.25, time.process_time() - start)


def test_literals_inside_base_spans_by_definition():
    text = "password = 'Zx81QaLm77' token=abcdef pwd = \"Zx81QaLm78\" secret: 'short' auth_secret = 'K9fj2Lx0pq' " * 40
    inside = [(a, b) for k, a, b in s.scan(text) if k != "literal"]
    assert {(a, b) for k, a, b in s.scan(text) if k == "literal"} == {x for x in s.literals(text) if not any(a <= x[0] and x[1] <= b for a, b in inside)}


def test_values_of_any_length_and_number_of_parts():
    many = [f"Zx{k:03d}Qa" for k in range(300)]
    assert found("part = " + " + ".join(f'"{m}"' for m in many) + "\nsecret = part") == set(many)
    assert found("a0 = 'Zx'\n" + "".join(f"a{k + 1} = a{k} + '{m}'\n" for k, m in enumerate(many)) + "pwd = a300") == {"Zx", *many}
    assert found("pwd = '" + "aB3$" * 2000 + " '") == set()
    assert found("a = '" + "a" * 5000 + "'\npwd = a + '" + "Zx81QaLm#" * 2000 + "'") == {"a" * 5000, "Zx81QaLm#" * 2000}
    assert found("pwd = '" + "example" * 1000 + "9$Q'") == found("pwd = '" + "x" * 9000 + "'") == set()
    assert found("a = 'Zx81QaLm'\n" + "a = a + a\n" * 5000 + "pwd = a") == {"Zx81QaLm"}


def test_query_on_the_whole_table(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in QUERIES["op3_secret_scan"](spark, SF_DIR).collect():
        spans = base(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in spans) for kind in ("assign", "access", "hex"))
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_hard_rows(spark, docs):
    rows = [(1, None), (2, ""), (3, "token=" + "a" * 100_000), (4, "=:" * 20_000), (4, "=:" * 20_000), (None, 'é 👍 pwd = "K9fj2Lx0pq"'), (6, '"' * 50_000), (7, "a = " * 20_000), (8, "a+" * 20_000)]
    got = {r.doc_id: r for r in s.secrets(docs(*rows)).collect()}
    assert got[1].base_sha256 == got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[1].spans == ""
    assert (got[3].n_assign, got[3].n_hex) == (1, 1) and got[None].spans == "literal:11:21"
    assert s.secrets(docs("x").limit(0)).count() == 0
