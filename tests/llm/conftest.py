import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Document tables from (doc_id, text) rows."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    return make


SENTENCE = "the quick brown fox jumps over the lazy dog and runs far away from here today. "
ODD = [(None, None), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, SENTENCE), (5, SENTENCE), (6, SENTENCE), (None, SENTENCE), (7, "é" * 3000 + " " + SENTENCE * 400),
       (8, "x" * 20000), (9, "a b\x00c 😀")]


@pytest.fixture(scope="session")
def odd(docs_of):
    """Null ids and texts, empty and blank texts, repeated rows, ties, a long text, a long word, and columns named as the operators' own."""
    d = docs_of(ODD)
    for name in ("spans", "ids", "score", "removed", "kept", "h1", "h2", "component", "node", "key", "doc", "size", "seeds", "places", "row", "predicted", "block"):
        d = d.withColumn(name, F.lit("mine"))
    return d
