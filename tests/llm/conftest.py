import pytest

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(80))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog today.\nAll rights reserved and more text here.", "en", "a", 10),
    (2, "The quick brown fox jumps over the lazy dog today.\nAll rights reserved and more text here.", "en", "a", 10),  # exact copy
    (3, None, "en", "b", None),
    (4, "", None, "b", 0),
    (5, "   \n\t ", "de", None, 5),
    (6, "12345 678", "fr", "c", 9),
    (7, LONG, "en", "a", 1),
    (8, LONG + " tail", "en", None, 1),
    (9, PASSAGE + " end of the ninth text", "de", "c", 1),
    (10, "begin of the tenth " + PASSAGE, None, "a", 1),
    (11, "Überraschung für größere Häuser – schön, daß Sie da sind.\n\n\nZeile", "de", "b", 3),
    (None, "no id but some words in it for all of us to see", "en", "a", 2),
    (12, "one", "en", "d", 2),
    (12, "one", "en", "d", 2),  # repeated row
    (12, "one other text under the same id", "en", "d", 2),
]
CLASHES = ["doc_key", "runs", "left", "n_removed", "size", "passes", "take", "row", "cls", "th", "h", "rank", "salt", "score", "a.b", "lang_pred", "piece"]


@pytest.fixture(scope="session")
def odd(spark):
    """Null cells, empty and long texts, copies, repeated rows and columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASHES}).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
