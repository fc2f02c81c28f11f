import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with an extra column that clashes with internal names."""

    def make(rows):
        full = [(i, t, lang, source, None if t is None else len(t), "x") for i, t, lang, source in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, id string")

    return make


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Nulls in all columns, empty, blank and long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(20000))
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", "a"), (None, "some words here", "en", None), (4, long, "en", "a"), (4, long, "en", "a"), (5, "one", "de", "b"), (6, "🙂 é\x00 ▁ ok", "de", "b")]
    return docs_of(rows)


@pytest.fixture(scope="session")
def no_docs(docs_of):
    return docs_of([])
