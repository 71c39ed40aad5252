import pytest
from pyspark.sql import types as T

#: Columns of documents, and some whose names operators use for themselves.
CLASHING = ["own_text", "own_words", "own_host", "own_failures", "own_id", "own_hash", "own_source", "own_cell", "own_place", "own_bad", "range_shard", "id", "Tokens", "shard", "position", "bit", "a.b", "left", "decoded_text"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)
PROSE = "The quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree near the quiet river."


def rows(*docs):
    """Rows of the schema from (doc_id, text) or (doc_id, text, source)."""
    return [(d[0], d[1], "en", d[2] if len(d) > 2 else "src0", None if d[1] is None else len(d[1]), *["x"] * len(CLASHING)) for d in docs]


@pytest.fixture(scope="session")
def make(spark):
    return lambda *docs: spark.createDataFrame(rows(*docs), SCHEMA)


@pytest.fixture(scope="session")
def awkward(make):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, ties."""
    long_ = " ".join(f"w{i}" for i in range(60_000))
    return make(
        (1, PROSE), (1, PROSE), (2, None), (3, ""), (4, " \n\t "), (None, PROSE), (None, None), (5, long_), (6, PROSE, None), (7, "日本語 🎉 ½ é", "src1"), (8, PROSE + " More words follow here.", "src1"), (9, "x" * 50_000), (10, "?!"), (10, "other text of the same id"),
    )


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
