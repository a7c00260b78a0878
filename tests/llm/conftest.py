from __future__ import annotations

import pytest

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text) pairs, with columns whose names clash with the operators' own."""
    def build(rows, clash=True):
        full = [(d, t, "en", f"src{(d or 0) % 3}", len(t or "")) for d, t in rows]
        df = spark.createDataFrame(full, DOC_SCHEMA)
        if clash:
            for name in ("h", "node", "kept", "n_words", "component_id", "start", "length", "blob", "spans", "n", "gone", "host", "piece"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df
    return build


@pytest.fixture(scope="session")
def sample_rows(duck):
    """(doc_id, text) of the small driver table."""
    return duck.execute("select doc_id, text from documents").fetchall()
