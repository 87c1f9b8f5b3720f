import pytest


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table with extra columns whose names clash with results' names."""

    def make(rows):
        extra = "score double, n_tokens string, row long, word string, spans int, block int"
        return spark.createDataFrame([(i, t, "xx", None, None, 0.5, "n", 1, "w", 2, 3) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")

    return make
