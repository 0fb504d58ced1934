import pytest
from pyspark.sql import functions as F

#: Column names that operators use inside; tables may have them, too.
CLASHING = ["row", "_text", "_lang", "n_words", "kept", "fp", "id", "mark", "runs", "place", "a", "s", "label", "score", "size", "bin", "word"]
LONG = "lorem ipsum " * 60_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    rows = [
        (None, None, None, None, None),
        (1, "", "en", "a", 0),
        (2, None, "en", "a", None),
        (3, " \n\t ", None, "a", 4),
        (4, LONG, "en", None, len(LONG)),
        (5, "A small text with a few more than ten words in it, all of them plain.", "en", "b", 60),
        (5, "A small text with a few more than ten words in it, all of them plain.", "en", "b", 60),
        (6, "a small TEXT with a few more than ten words in it, all of them plain.", "en", "b", 60),
        (7, "Ça va très bien, même après la pluie 東京 🙂 and then some more words here.", "fr", "b", 70),
        (None, "No id but words enough to pass the rule that asks for ten of them.", "en", "b", 66),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("other") for c in CLASHING})


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


def documents(spark, texts, lang="en"):
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
