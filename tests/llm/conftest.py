import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents rows from (doc_id, text) pairs, with extra columns whose names clash with those that operators make."""

    def make(rows):
        full = [(i, t, "en", "src0", len(t or ""), "x", 1, "y") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score string, piece int, words string")

    return make
