import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, marks outside ASCII."""
    long = " ".join(f"word{i % 977} at{i}" for i in range(20_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", 10),
        (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", 10),
        (2, None, None, None, None),
        (3, "", "en", "b", 0),
        (4, " \t\n ", "fr", "b", 0),
        (5, "12345 67", "en", "b", 0),
        (6, long, "en", None, None),
        (None, "Größe über alles 日本語 \U0001f600 ende", "de", "c", 1),
        (7, "x", None, "c", 1),
        (-8, "a" * 3000, "en", "c", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, data):
    from tallywise.llm.common import table

    return table(spark, data, "documents")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
