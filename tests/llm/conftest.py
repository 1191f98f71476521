import pytest

LONG = "lorem ipsum dolor sit amet " * 6000


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls everywhere, empty and very long texts, ties, repeated rows, and clashing extra columns."""
    body = "the quick brown fox jumps over the lazy dog while the band plays on and on until late at night"
    rows = [
        (1, body, "en", "a", 1), (1, body, "en", "a", 1), (2, body.replace(" ", "\n\t"), None, None, None),
        (3, "", "en", "a", 0), (4, None, "en", "b", None), (None, body + " again", "en", "b", 3), (None, None, None, None, None),
        (5, LONG, "en", "b", 9), (6, " \t ", "en", "c", 2), (7, "one", "en", "c", 2), (8, "one", "en", "\U0001F600", 2),
        (9, "café \U0001F600   end", "fr", "￮", 2), (-3, body.upper(), "en", "a", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", "1 as id", "2 as key", "3 as row", "4 as size", "'x' as kept", "5 as hash", "6 as part",
                           "7 as fp", "8 as k", "9 as code", "10 as weight", "11 as copies", "12 as body", "13 as sha")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
