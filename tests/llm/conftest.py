import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    rows = [
        (1, "a b c d e", "en", "s1", 9), (2, "a  b c d e", "en", "s1", 10), (3, "abcde", None, None, 5), (4, None, "en", "s2", None), (5, "", "en", "s2", 0),
        (6, " \n\t", "en", None, 3), (7, "word " * 60_000, "en", "s1", 300_000), (8, "x" * 200_000, "en", "s1", 200_000), (9, "Ünïcödé 日本語 😀 text", "de", "s3", 20),
        (10, "a b c d e", "en", "s1", 9), (10, "a b c d e", "en", "s1", 9), (11, "<|endoftext|> it's 1234 +1 (017) 555-7713 bob@mail.example.com", "en", "s4", 60), (None, "lost", "en", "s4", 4),
        (12, "the quick brown fox jumps over the lazy dog and runs away from all of the other animals", "en", "s1", 80),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd_documents):
    """The same with extra columns whose names operators give to their own."""
    from pyspark.sql import functions as F

    names = ("size", "shard", "SLOT", "law", "score", "held_out", "n_tokens", "spans", "copy_no", "mix_key", "kept", "fingerprint", "component_id", "edits", "label", "key")
    return odd_documents.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
