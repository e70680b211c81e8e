import pytest

#: Null, empty, blank, letterless, repeated and long texts; a null key and a repeated row.
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "123 456 !?"), (5, "one two three four five six seven eight"),
       (6, "one two three four five six seven eight"), (6, "one two three four five six seven eight"),
       (7, "ONE two three four five six seven eight"), (8, "héllo wörld — naïve café Ελένη 日本語 😀  x"),
       (9, "word " * 30000), (None, "a key is missing here, yet the text is whole"), (10, "two words")]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with extra columns whose names clash with those that operators add or use."""
    rows = [(i, t, "en", "s", 0, 0.5, "x", 7) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, "
                                       "key string, label int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
