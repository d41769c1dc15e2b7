"""Small documents with every awkward case, and the larger supplied ones."""

import random

import pytest

DATA = "/root/testdata/sf0.001"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


@pytest.fixture
def awkward(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids, a clashing extra column."""
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta,", "eta.", "theta"]
    long = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(30_000))
    some = " ".join(rng.choice(words) for _ in range(60))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, None), (4, long, "en", "a", 1),
        (5, some, "de", "b", 1), (5, some, "de", "b", 1), (6, some, "de", "b", 1), (5, some + " other end", "de", "b", 1),
        (None, some, "de", None, 1), (None, None, None, None, None), (7, "!!! 123 ???", "fr", "b", 1),
        (8, "aaaa" * 100, "fr", "b", 1), (9, "日本語 テキスト ñ 🙂 \x1c\xa0x", "fr", "b", 1), (-3, "aaaa" * 90, "fr", "b", 1),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCUMENT)
    for name in ("score", "grp", "to", "place", "tie", "key", "items", "found", "class_id", "body"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENT)
