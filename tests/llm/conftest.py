import pytest

LONG = " ".join(f"word{i % 977} filler" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and very long texts, repeated rows, and columns whose names clash with the operators' own."""
    rows = [
        (1, "a plain text with several common words in it", "x"), (1, "a plain text with several common words in it", "x"), (2, None, None), (3, "", "y"),
        (4, LONG, "z"), (5, LONG, "z"), (None, "a text without an id", None), (6, "\n \t", "w"), (7, "é ß 汉字 😀 ıİ", None), (8, "short", "v"),
    ]
    kinds = "doc_id long, text string, source string"
    clash = "h string, n long, rep long, key string, score double, ids string, copy string, id long, label string, kept string, r string, model string"
    return spark.createDataFrame([(*r, *([None] * 12)) for r in rows], f"{kinds}, {clash}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
