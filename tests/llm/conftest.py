import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text, source) with a column whose name may clash."""

    def make(rows, schema="doc_id long, text string, source string, size string, h string, node string"):
        return spark.createDataFrame([(i, t, s, "size?", "h?", "node?") for i, t, s in rows], schema)

    return make
