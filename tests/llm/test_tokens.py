import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plantwatch.llm import pieces, token_counts, token_files
from plantwatch.llm.queries import QUERIES, vocabulary
from tests.conftest import SF_DIR

HARD = ["", None, "a", " a", "a ", "a  b", "a \n b\n\n c", "x\ty \r\n z", "it's  'll <|endoftext|> b<|endoftext|>", "é  ü\x1c y\x1cz !\x1c!",
        "日本語 テキスト　 了", "word " * 5000, "12 3,4.5 ...  !!", "\0a \0 b", "<|endoftext|>", "👍🏽 é ​ x"]


@lru_cache
def tokenizer(name):
    return pieces.load(vocabulary(name))


def ids_of(text, name="byte_bpe_50k.json"):
    return tokenizer(name).encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library_on_hard_texts(spark, docs):
    got = {r.doc_id: r for r in token_counts.token_counts(docs(*HARD), vocabulary()).collect()}
    for k, text in enumerate(HARD):
        n = len(ids_of(text))
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len((text or "").encode()), n > 1024)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_of_other_layouts(spark, docs, name):
    texts = ["Hello  World", None, "", "a b c"]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs(*texts), vocabulary(name)).collect()}
    if name.endswith(".json"):
        want = [len(ids_of(t, name)) for t in texts]
    else:
        from sentencepiece import SentencePieceProcessor

        want = [len(SentencePieceProcessor(model_file=vocabulary(name)).encode(t or "")) for t in texts]
    assert [got[k] for k in range(4)] == want


def test_count_query_equals_the_library_on_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    got = {r.doc_id: r.n_tokens for r in QUERIES["op6_token_counts"](spark, SF_DIR).collect()}
    assert got == {r.doc_id: len(ids_of(r.text)) for r in rows}


def test_empty_table_and_null_id(spark, docs):
    assert token_counts.token_counts(docs("a").limit(0), vocabulary()).count() == 0
    assert token_files.token_files(docs("a").limit(0), vocabulary()).count() == 0
    got = token_counts.token_counts(docs((None, "a"), (1, "b"), (1, "b")), vocabulary()).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in got) == [(False, 1), (False, 1), (True, 1)]


@given(st.text(alphabet=st.sampled_from(list(" \n\t \x1cab1'.,é語\0|<>")), max_size=40))
@settings(max_examples=300, deadline=None)
def test_pieces_are_safe(text):
    cut = pieces.pieces(text)
    assert "".join(cut) == text
    assert [i for p in cut for i in ids_of(p)] == ids_of(text)


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), min_size=1, max_size=500), st.floats(0.01, 1.0))
@settings(max_examples=100, deadline=None)
def test_blocks_round_trip(ids, percentile):
    ids = np.array(ids, "<u4")
    assert (token_files.unpack_block(token_files.pack_block(ids, percentile)) == ids).all()


def test_outliers_go_to_the_exception_list():
    ids = np.full(1000, 7, "<u4")
    ids[500] = 2**31
    assert len(token_files.pack_block(ids)) < 30


def check_files(rows, got):
    want, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of(text) + [0]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    order = lambda r: r[1]
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=order) == want


def test_files_equal_the_library(spark, docs):
    rows = [(k * 3 % 16, t) for k, t in enumerate(HARD)] + [(2, "again"), (2, "again"), (None, "no id")]
    check_files(rows, token_files.token_files(docs(*rows), vocabulary(), file_ids=600).collect())


def test_file_query_on_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    check_files(rows, QUERIES["op7_token_files"](spark, SF_DIR).collect())


def test_a_span_opens_only_its_blocks():
    ids = np.arange(3 * token_files.BLOCK + 5, dtype="<u4")
    data = b"".join(token_files.pack_file([(4, ids[:10].tobytes()), (9, ids[10:].tobytes())]))
    keys, _, counts, span = token_files.read_file(data)
    assert keys.tolist() == [4, 9] and counts.tolist() == [10, len(ids) - 10]
    assert (span(4000, 9000) == ids[4000:9000]).all()
