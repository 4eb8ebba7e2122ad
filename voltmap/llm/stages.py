"""The pipeline's stages: (spark, docs, sf_dir) -> DataFrame, each on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F



def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold, as trained on the labels table."""
    from voltmap.llm import toxicity

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    train = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(train, labels)
    score = toxicity.scorer(spark, model)
    return docs.filter(score("text") < toxicity.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id."""
    from voltmap.llm import neardup

    kept = neardup.classes(docs).filter("keep").select(F.col("key").alias("_kept")).distinct()
    own = docs.withColumn("_key", neardup.row_key("doc_id", "text"))
    first = Window.partitionBy("_key").orderBy(F.lit(0))
    return (
        own.join(kept, F.col("_key") == F.col("_kept"), "left_semi")
        .withColumn("_n", F.row_number().over(first))
        .filter("_n = 1")
        .select(*docs.columns)
    )


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; emptied ones go."""
    from voltmap.llm import substrings

    return substrings.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per take of the source mix."""
    from voltmap.llm import mixing

    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in packed sequences."""
    from voltmap.llm import packing

    packed = packing.pack(packing.tokenize(docs))
    return packed.select(
        F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
