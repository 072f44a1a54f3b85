import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, kept string, g string"


@pytest.fixture(scope="session")
def tiny(spark):
    """Makes a documents table of (doc_id, text) rows, with extra columns whose names clash with the operators' own."""

    def make(rows, partitions=3):
        return spark.createDataFrame([(i, t, None, "s", None, "x", "y", "z") for i, t in rows], SCHEMA).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and blank texts, ties, repeated rows and a very long text."""
    long = "lorem ipsum dolor " * 20_000
    return [(1, None), (2, ""), (3, "  "), (4, "a b c d"), (5, "a b\tc  d"), (5, "a b\tc  d"), (6, "a b c d "), (7, long), (8, long), (9, long + "x"), (None, "no id"), (10, "no id"), (11, "ünï cödé ßtring 漢字 🙂"), (12, "A" * 5000 + "b"), (13, "A" * 5000 + "c"), (14, "A" * 5000 + "b")]
