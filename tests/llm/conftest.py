import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    parts = ["the", "of", "an", "ing", "tion", "er", "ed", "ou", "ble", "é", "ñ", "th", "ha", "re"]
    out = []
    for k in range(words):
        word = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
        out.append(word + (rng.choice([".", ","]) if rng.random() < 0.1 else "") + ("\n" if k % 23 == 22 else " "))
    return "".join(out).strip()


def odd_rows() -> list[tuple]:
    """Null and empty texts, a null id, repeated rows, equal texts, a very long text, odd white space and characters."""
    same = prose(1, 150)
    return [
        (1, None, "en", "a", None),
        (2, "", None, "a", 0),
        (3, "   \n\t ", "en", None, 6),
        (4, same, "en", "a", 1),
        (5, same, "en", "b", 1),
        (5, same, "en", "b", 1),
        (None, prose(2, 80), "en", "c", 1),
        (6, prose(3, 60_000), "en", "a", 1),
        (7, "word", "en", "a", 4),
        (8, "two  words   日本語   x\r\ny", "en", "a", 4),
        (9, prose(4, 400) + " " + same, "en", "a", 4),
        (10, prose(4, 401), "en", "a", 4),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with columns named like those that the operators use inside."""
    from pyspark.sql import functions as F

    names = (
        "id", "key", "fp", "score", "spans", "label", "length", "piece", "t1", "share", "component_id", "h", "stays", "digest", "copies", "record_id", "original", "payload",
        "_share", "_number", "_text_hash", "_h", "_k1", "_k2", "_id", "_n_hit", "_n_words", "_items", "_spans", "_statistics", "__n_hit",
    )
    return odd.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
