import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, key string"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text, lang, source) as a table with the columns of documents and two that clash with inner names."""

    def make(rows):
        full = [(*r, None if r[1] is None else len(r[1]), "d", "k") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (None, "A text without an id, but with some words.", "en", None),
    (3, "One two three four five six seven eight nine ten.\nA repeated line of text\nlast", "en", "a"),
    (3, "One two three four five six seven eight nine ten.\nA repeated line of text\nlast", "en", "a"),
    (4, "\t A REPEATED line of text \r\nother words here, and more of them\n\n", "en", "b"),
    (5, "word " * 30_000, "en", "b"),
    (6, "日本語 ​ <|endoftext|> \x1c x", "ja", "b"),
    (7, "... 123 !!!", None, "c"),
]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD)


@pytest.fixture(scope="session")
def empty(documents):
    return documents([])
