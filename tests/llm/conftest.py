import pytest

LONG = "alpha beta gamma " * 20_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from here", "en", "a", 10, "x"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from here", "en", "a", 10, "x"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from here", "en", "a", 10, "x"),
    (3, None, None, None, None, None),
    (4, "", "en", "b", 0, "y"),
    (5, " \t\n ", "en", "b", 4, "y"),
    (None, "no id here", "en", None, 3, "z"),
    (6, LONG, "de", "b", 1, "z"),
    (7, "Été à la plage — <|endoftext|> 日本 don't", "fr", "c", 7, "z"),
    (8, "word", "en", "c", 1, "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, {} string"


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls, empty and very long texts, repeated rows, and an extra column of any name."""
    return lambda extra="extra": spark.createDataFrame(ROWS, SCHEMA.format(f"`{extra}`"))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA.format("extra"))
