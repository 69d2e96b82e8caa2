import pytest

TEXT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from texts, with ids from 0, or from (id, text) pairs."""

    def make(rows):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, None, "s", len(t) if t is not None else None) for i, t in pairs], TEXT_SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like those that operators use inside."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "   \n\n  "), (None, "no id here at all"), (None, None), (4, long), (5, long), (6, "a b c"), (6, "a b c"), (6, "another text of the same id"), (7, "x" * 200_000), (8, "é" * 5000 + "\x00\ufffd")]
    schema = "doc_id long, text string, fp long, id long, label int, tokens binary, score double, n_chars long, root string"
    return spark.createDataFrame([(i, t, 1, 2, 3, b"", 0.5, None, "r") for i, t in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
