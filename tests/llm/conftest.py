import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"

LONG = " ".join(f"w{i}" for i in range(30_000))
ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n ", "de", None, 0),
    (4, "the quick brown fox jumps over the lazy dog by the river", None, "b", 1),
    (4, "the quick brown fox jumps over the lazy dog by the river", None, "b", 1),
    (5, "the quick brown fox jumps over the lazy dog by the river", "en", "b", 1),
    (None, "the quick brown fox jumps over the lazy dog by the sea", "en", None, None),
    (7, LONG, "en", "c", 7),
    (8, LONG + " end", "en", "c", 7),
    (9, "x" * 100_000, "fr", "c", 7),
    (10, "1" * 5_000 + " 1-2-" * 3_000 + "a.b@" * 2_000, "fr", "c", 7),
    (11, "naïve  café ß Ünïcode \U0001f600 mail a.b@c.example.com, +1 (213) 555-0199 or 4111 1111 1111 1111", "fr", "d", 9),
    (12, "one two", "es", "é", 2),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and more columns whose names the operators use themselves."""
    rows = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    names = ["label", "node", "n", "comp", "size", "shard", "rate", "target", "_key", "_row", "word", "_id", "offset",
             "spans", "n_words", "kept", "_rank", "_draw", "_shard", "_stratum"]
    return rows.select("*", *[F.lit("clash").alias(name) for name in names])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")
