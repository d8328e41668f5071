import pytest


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Writes documents (doc_id, text[, lang, source, n_chars]) with columns of other names, and gives them as a DataFrame."""

    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long, words string, node long, key string"):
        full = [(*r, *(None,) * (8 - len(r))) for r in rows]
        return spark.createDataFrame(full, schema).repartition(3)

    return make


ODD = [(1, None, "en", None), (2, "", "en", "s"), (3, " \t\n ", None, "s"), (None, "a b c d e f g h i j k l", "en", "s"), (4, "word " * 30000, "en", "s"), (5, "x" * 300_000, "en", "t"), (6, "same text of a few more words than ten in one line", "en", "t"), (6, "same text of a few more words than ten in one line", "en", "t"), (7, "Été naïve ΣΑΣ J̌ é <|endoftext|> A, b. C", "fr", "u")]


@pytest.fixture(scope="session")
def odd(tables):
    return tables(ODD)


@pytest.fixture(scope="session")
def empty(tables, spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
