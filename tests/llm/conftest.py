import pytest

from riskloom.llm import queries  # noqa: F401

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs_of(spark):
    """Documents from (doc_id, text[, lang[, source]]) tuples, with columns that clash with internal names."""
    def make(rows, extra=True):
        full = [(*r, *[None] * (4 - len(r)), None) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        if extra:
            df = df.selectExpr("*", "1 as key", "'x' as kept", "2 as size", "3 as score", "4 as digest", "5 as node")
        return df
    return make
