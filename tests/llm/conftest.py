import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def docs(spark):
    """A documents table of ``{id: text}`` or of (id, text) rows, in several partitions."""

    def make(texts, partitions=3):
        rows = texts.items() if isinstance(texts, dict) else texts
        frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        return frame.repartition(partitions)

    return make


@pytest.fixture
def corpus(table):
    """The documents of the small test tables, as a list of (id, text)."""
    return [(r["doc_id"], r["text"]) for r in table("documents").select("doc_id", "text").collect()]


#: Texts that are awkward for any operator.
ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "word"),
    (5, "Ünïcödé 漢字   and 🙂 emoji"),
    (6, "same words again and again " * 3000),
    (7, "tie tie tie"),
    (7, "tie tie tie"),
    (None, "a row without an id"),
    (None, None),
    (8, "\n\n\n"),
    (9, "x" * 300_000),
]
