import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, label int, node long, rank int, shard int, class string, w string, y int, size int"


def rows_of(texts):
    return [(i, t, lang, "s", None, "k", 1, 2, 3, 4, "c", "w", 5, 6) for i, t, lang in texts]


@pytest.fixture(scope="session")
def prose():
    """n texts of invented words."""

    def make(n, seed=0, least=20, most=120):
        r = random.Random(seed)
        words = ["".join(r.choices(["ta", "ri", "no", "sel", "mor", "ent", "ing", "u"], k=r.randint(1, 4))) for _ in range(400)]
        return [" ".join(r.choices(words, k=r.randint(least, most))) + "." for _ in range(n)]

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    p = prose(6)
    texts = [(1, p[0], "en"), (1, p[0], "en"), (2, None, None), (3, "", "en"), (None, p[1], None), (None, p[1], None), (None, None, None), (4, "?! ... 123", "en"), (5, "x" * 40_000 + " " + "long words here " * 3000, "en"), (6, p[2], "fr"), (7, p[3], "fr"), (8, "one two", "fr"), (9, "\x00\t\n  ", "en"), (10, "日本語 \U0001f600 é", "en")]
    return spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (6, 0, 1), (7, None, None), (None, 1, 1), (99, 1, 1), (8, 7, 7)], "doc_id long, quality int, toxic int")


@pytest.fixture
def docs_of(spark):
    return lambda texts: spark.createDataFrame(rows_of([(i, t, lang) for i, (t, lang) in enumerate(texts)]), SCHEMA)
