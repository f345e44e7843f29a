import pytest
from pyspark.sql import functions as F

from tests.conftest import FOLDER

SENTENCE = "the quick brown fox jumps over a lazy dog while many small birds sing in the old green tree ."


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


def odd_rows():
    long = " ".join(f"w{i % 7919}" for i in range(60_000))
    passage = "\n".join(f"{SENTENCE} part {i}" for i in range(4))
    return [
        (1, None, None, None), (2, "", "a", "en"), (3, "  \n\t \n", "a", None), (4, "one", "b", "en"), (5, long, "b", "en"), (6, long + " end", None, "en"),
        (7, passage, "a", "en"), (7, passage, "a", "en"), (8, passage, "c", "en"), (9, f"before it\n{passage}\n\nafter it", "c", "de"), (None, SENTENCE * 5, "c", "de"),
        (None, SENTENCE * 5, "c", "de"), (10, "Üñï \U0001f600 日本 <|endoftext|> it's\x1c x\x00y", "d", "ja"), (11, "a\r\nb\x0bc\x0cd", "d", "fr"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns with clashing names."""
    d = spark.createDataFrame(odd_rows(), "doc_id long, text string, source string, lang string")
    clash = ["d", "t", "i", "e", "k", "n", "w", "key", "band", "part", "halo", "piece", "length", "offset", "rank", "line", "host", "path", "good", "rate", "weight", "mix_copy",
             "clean_text", "kept", "n_lines", "fingerprint", "score", "sequence_id", "start", "y", "fit"]
    return d.select("*", F.length("text").cast("long").alias("n_chars"), *[F.lit(1).alias(c) for c in clash]).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
