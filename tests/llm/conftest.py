import random

import pytest

LONG = " ".join(f"w{i % 977}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows; ids are not ordered."""
    rnd = random.Random(3)
    texts = ["", None, " ", "\n\n", "a", "The same line stands here again.\nb\nThe same line stands here again.", LONG, "x" * 5000, "é ñ ü\n  Ünïcode line with more than twenty points"]
    texts += [f"The same line stands here again.\n{rnd.random()} tail" for _ in range(4)]
    rows = [(i * 7 % 23, t) for i, t in enumerate(texts)] + [(100, "twice"), (100, "twice"), (101, "twice"), (None, "twice"), (None, None)]
    return rows


def frame(spark, rows):
    """The rows as documents, with further columns whose names clash with working names."""
    return spark.createDataFrame([(*r, "x", 1, None) for r in rows], "doc_id long, text string, digest string, salt int, hash string")


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
