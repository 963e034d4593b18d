import pytest
from pyspark.sql import functions as F

from chartline.llm.common import importable

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    importable(spark)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows."""

    def make(*rows):
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1])) for r in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in every column, empty, blank and long texts, repeated rows, equal texts."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return make_docs((1, None, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "Two words"), (None, "a text without an id", None), (6, long, "b"), (7, long, "c"), (8, "same row"), (8, "same row"),
                     (9, "x" * 50_000), (10, "😀 é ß 漢字 a b"))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(make_docs):
    """Columns with the names that operators use inside."""
    d = make_docs((1, "some words of a text", "a"), (2, "some words of a text", "b"), (3, "other words", "a"))
    for c in ("size", "key", "fp", "score", "n", "rate", "spans", "_keep_me", "copies", "target", "part", "rank"):
        d = d.withColumn(c, F.lit("own"))
    return d
