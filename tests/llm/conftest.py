import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 8000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rows = [
        (1, "The cat sat on the mat and the dog sat on the log.", "en", "b", 10),
        (2, "The cat sat on the mat and the dog sat on the log.", "en", "b", 10),
        (2, "The cat sat on the mat and the dog sat on the log.", "en", "b", 10),
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (5, " \t\n ", "fr", "a", 4),
        (6, LONG, "la", "c", len(LONG)),
        (7, "one two", None, "c", 7),
        (8, "ONE TWO", "en", None, 7),
        (9, "1234 5678 ... !!!", "de", "a", 17),
        (10, "<|endoftext|> É é ① ṉ̃ 中文", "fr", "b", 9),
        (None, "a text without an id", "en", "a", 20),
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def wide(odd):
    """Further columns whose names clash with those of results."""
    from pyspark.sql import functions as F

    names = ("score", "predicted", "held_out", "n_tokens", "start", "target", "taken", "copies", "block", "n", "cls", "stratum", "kept", "sequence_id", "piece", "root", "quality", "kind", "k", "size")
    return odd.select("*", *(F.lit("clash").alias(n) for n in names))
