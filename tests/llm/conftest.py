import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A documents-like table of (doc_id, text) pairs with columns whose names clash with those the operators use inside."""

    def make(rows, ids="bigint"):
        full = [(i, t, "src", 7, 8, 9, "x", 1) for i, t in rows]
        return spark.createDataFrame(full, f"doc_id {ids}, text string, source string, id int, fp int, component int, row string, n int").repartition(3)

    return make


CASES = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "lost words here"), (7, "\n"), (8, "é" * 50_000)]


@pytest.fixture(scope="session")
def cases():
    """NULL, empty and blank texts, ties, repeated rows, a NULL id, a very long text."""
    return CASES
