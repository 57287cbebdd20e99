import pytest

LONG = "lorem ipsum dolor sit amet " * 20_000


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, a clashing further column."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43, "x"), (2, "the quick brown fox jumps over the lazy dog", "en", "b", 43, "y"), (3, None, None, None, None, None), (4, "", "en", "a", 0, "z"), (4, "", "en", "a", 0, "z"),
        (5, LONG, "la", "c", len(LONG), "w"), (6, "😀 é  ß\t\n  x", "xx", "a", 9, None), (None, "no id at all here today", "en", "a", 24, "v"), (7, " ", "en", "d", 1, "u"), (7, "another text of a repeated id", "en", "d", 29, "t"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
