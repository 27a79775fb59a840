import pytest

#: Nulls, empty and very long texts, repeated rows, a repeated id with another text, white space of all sorts.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "a"),
    (2, "The quick brown fox jumps over the lazy dog again and again", "a"),
    (3, None, "b"),
    (4, "", None),
    (5, " \t\n", "b"),
    (None, "the quick brown fox jumps over the lazy dog again and again", "b"),
    (7, "one two", "c"),
    (7, "one two", "c"),
    (8, "another text altogether, which nobody else has written before", "c"),
    (8, "repeated id with a different text, as it may come", "c"),
    (9, "x" * 70_000 + " " + "word " * 20_000, "a"),
    (10, "naïve Straße 日本語 🙂 \u0000 end", "é"),
    (11, "one two", None),
]


@pytest.fixture(scope="session")
def docs(spark):
    """The rows with extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    extra = {c: F.lit("extra") for c in ("id", "node", "kept", "h", "size", "copies", "score", "_id", "_n", "text_sha256", "pattern", "x")}
    return df.withColumns(extra).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
