import sys

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names an operator might use itself."""

    def make(rows, lang="en", source="s"):
        data = [(i, t, lang, source, len(t or ""), 1, "x", None) for i, t in rows]
        return spark.createDataFrame(data, DOCS + ", n_words int, id string, size double")

    return make


@pytest.fixture(scope="session", autouse=True)
def top():
    sys.setrecursionlimit(5000)
