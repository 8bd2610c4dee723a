import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash long, anchor long, y int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table with columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, lang, "s", None if t is None else len(t), 1, 2, 3) for i, t, lang in rows]
        return spark.createDataFrame(full, DOCS)

    return make


#: Rows that every operator must take: null, empty, blank, very long, repeated, no id.
ODD = [
    (1, None, None),
    (2, "", "en"),
    (3, " \t\n ", "en"),
    (4, "one", None),
    (5, "word " * 60_000, "en"),
    (6, "a b c d e f g", "en"),
    (6, "a b c d e f g", "en"),
    (None, "a b c d e f g", "en"),
    (7, "日本語 🤖 ß é ▁ <s>", "xx"),
]


@pytest.fixture(scope="session")
def odd(make_docs):
    return make_docs(ODD)


@pytest.fixture(scope="session")
def empty(make_docs):
    return make_docs([])
