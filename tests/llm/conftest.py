import pytest


@pytest.fixture()
def docs_of(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang, source)."""

    def make(rows, extra=""):
        full = [(*r, *("en", "s0")[len(r) - 2 :], len(r[1] or "")) if len(r) < 4 else (*r[:4], len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", *([extra] if extra else []))

    return make
