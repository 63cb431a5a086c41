import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


ODD = "doc_id long, text string, lang string, source string, n_chars long, size string, h string, name long, row int, __id string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, one id with two texts, clashing extra columns."""
    words = " ".join(f"w{i % 977}" for i in range(9000))
    rows = [
        (1, "the same text of five words", "en", "a"), (2, "the same text of five words", "en", "b"), (2, "the same text of five words", "en", "b"),
        (3, None, "en", "a"), (4, "", None, "a"), (5, " \n\t ", "de", None), (None, "no id here at all", "en", "a"), (None, None, None, None),
        (6, words, "en", "a"), (7, words + " end", "en", "b"), (8, words, "en", "c"), (9, "12345 !!! 678", "de", "c"),
        (10, "ünïcödé große Straße 𝒳 漢字 İ", "de", "c"), (11, "x", "de", "c"), (11, "another text under one id", "de", "c"),
        (12, "words\x0bparted\x0cby\x1cblanks or not", "en", "a"), (13, "The Same Text of five words", "en", "a"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", 5, 6, "z") for r in rows], ODD).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ODD)
