import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("row", T.StringType()), T.StructField("size", T.LongType())]
)


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with extra columns whose names the operators use too."""

    def make(*rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", "x", 7) for r in rows], DOCS)

    return make


@pytest.fixture
def words():
    """n different words that begin with a letter."""

    def make(n, start=0):
        return [f"w{i}x" for i in range(start, start + n)]

    return make


ODD = [(None, None), (None, "same words in a row here"), (1, ""), (2, " \t\n"), (3, None), (4, "one"), (4, "one"), (5, "Ünïcode — ﬁ \U0001f600 text"), (6, "a b c d"), (7, "ab " * 30000)]


@pytest.fixture
def odd(docs):
    """Null, empty, blank, repeated, short and very long texts, null and repeated ids."""
    return docs(*ODD)
