import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture
def make(spark):
    """Documents from texts, or from (id, text) pairs; extra columns clash with names the operators use inside."""

    def build(rows):
        rows = [(i, r) if not isinstance(r, tuple) else r for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", "src0", len(t) if t is not None else None, 7, "x", 1.5) for i, t in rows], DOCS + ", pos int, word string, score double")

    return build
