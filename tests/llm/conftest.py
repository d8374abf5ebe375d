import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows, extra=""):
        rows = [(i, t, "en", "s", None if t is None else len(t)) if not isinstance(t, tuple) else (i, *t) for i, t in rows]
        return spark.createDataFrame(rows, DOCS)
    return make
