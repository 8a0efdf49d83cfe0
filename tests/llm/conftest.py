import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source) tuples, with columns that clash with internal names."""

    def make(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make


ODD = [
    (1, "one two three"), (2, None), (3, ""), (4, " \n\t "), (None, "no key at all"), (None, None), (5, "same"), (5, "same"), (5, "other text of the same key"),
    (6, "é漢字🙂 a b"), (7, "x" * 50_000), (8, "word " * 9_000),
]


@pytest.fixture
def odd():
    return list(ODD)
