import pytest


@pytest.fixture
def docs(spark):
    """A documents table from texts, or from (id, text) pairs, with extra columns whose names clash."""

    def build(*texts, **extra):
        rows = [(t if isinstance(t, tuple) else (k, t)) for k, t in enumerate(texts)]
        rows = [(i, t, "en", f"src{k % 3}", len(t or ""), "x", 7, 0.5) for k, (i, t) in enumerate(rows)]
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, start int, score double"
        return spark.createDataFrame(rows, schema)

    return build
