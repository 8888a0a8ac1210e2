"""A corpus pipeline: from raw documents to shards of a training mixture.

Each stage takes all documents that its predecessor kept and returns documents
again; the last one adds the shards. Between stages the documents are written as
Parquet into the shared checkpoint folder and read again; what no later stage
reads is deleted.

In all stages a null text counts as empty, rows that repeat are rows like others
unless the stage says otherwise, extra columns are passed on, whatever their
names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import decontam, mixing, near_copies, quality, sharding
from marketloom.llm._shared import discarded, spread, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (operator 8).

    The classifier learns from the labelled rows among them. Repeated rows get one
    score; null and empty texts are scored by their statistics, all zero. Without
    any labelled row nothing is rejected.
    """
    docs = spread(docs)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.classify(docs, model).filter("predicted = 1").select(*[f"`{c}`" for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (operator 10): five-word shingles, similarity 0.8.

    The one with the smallest id stays. Texts without words are alike; rows without
    an id can't be named by a decision and stay; of rows that repeat an id the one
    with the smallest text stays.
    """
    return near_copies.drop_similar(spread(docs))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, edited by a fifth or less (operator 9). Null and empty texts and items hold nothing."""
    return decontam.drop_contaminated(spread(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in random order (operator 1).

    A null source is one of its own; a null id is drawn as the empty one; rows that
    repeat an id draw the same count.
    """
    return mixing.mix_sources(docs).select(*[f"`{c}`" for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot (operator 5). Equal texts share a shard; a column named like an added one gives way.

    Slots are in the order of a digest of each row's place in the stored table, so
    that the copies that mixing made aren't neighbours. Retries read the same
    places. Of a table that isn't stored the rows of one id are neighbours.
    """
    place = F.concat_ws(":", F.regexp_replace("_metadata.file_name", "-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", ""), F.col("_metadata.row_index"))
    try:
        placed = docs.withColumn("__place", place)
    except AnalysisException:
        return sharding.shard_documents(docs)
    return sharding.shard_documents(placed, order_col="__place")


STAGES = [
    ("quality", keep_good),
    ("near_dedup", keep_one_of_near_copies),
    ("decontaminate", keep_uncontaminated),
    ("mix", mix),
    ("shard", shard),
]

#: SQL can express neither the classifier nor the similarity.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of a folder."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        before = path
        docs, path = written(stage(spark, docs, sf_dir), name)
        if before:
            discarded(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
