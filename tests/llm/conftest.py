import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, digest string, fp string, key string, row string, size string, pos string"


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text) pairs, with columns whose names operators might use themselves."""
    return lambda *rows: spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "d", "f", "k", "r", "s", "p") for i, t in rows], COLUMNS)


#: Nulls, empty texts, white space, ties, repeated rows, a row without an id, a long word and a long text.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "Hello  World"), (5, "hello  world"), (5, "hello  world"), (None, "hello  world"), (6, "x" * 5000), (7, "a b c d e f g " * 3000), (8, "Éa éa 日本 😀")]


@pytest.fixture
def odd(docs):
    return docs(*ODD)
