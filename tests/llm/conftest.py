import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, copy int, sequence_id long, SCORE2 string"


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def row(doc_id, text, lang="en", source="s", n_chars=None):
    return (doc_id, text, lang, source, n_chars, 9.0, None, 7, 3, "x")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in each column, empty, blank and very long texts, repeated rows, clashing columns."""
    long = words(1, 60_000)
    rows = [
        row(None, "alone without an id"), row(1, None), row(2, ""), row(3, " \t\n \r"), row(4, long), row(4, long), row(5, words(2, 120)), row(6, words(2, 120), None, None),
        row(7, "one"), row(8, "é ß ✓ 语言 \U0001f600"), row(9, "…!!! 123 ###"), row(10, words(3, 80) + "\n" + words(3, 80)), row(None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
