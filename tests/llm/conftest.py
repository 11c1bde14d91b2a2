import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Clashing and extra columns that operators must pass by.
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, key string, hit boolean, size int, id string, c int, n int, gone int, n_bytes int, head int"


def docs_of(spark, rows, schema=DOCS):
    """Rows of (doc_id, text[, lang[, source]])."""
    n = len(schema.split(","))
    return spark.createDataFrame([(tuple(r) + (None,) * n)[:n] for r in rows], schema)


@pytest.fixture
def make_docs(spark):
    return lambda rows, schema=DOCS: docs_of(spark, rows, schema)


@pytest.fixture
def make_extra(spark):
    return lambda rows: docs_of(spark, rows, EXTRA)
