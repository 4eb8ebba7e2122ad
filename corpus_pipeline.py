"""From raw documents to packed training sequences, one stored stage after another."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from voltmap.llm import stages
from voltmap.session import shared_folder

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_duplicates", stages.drop_near_copies),
    ("repeated_passages", stages.drop_repeated_passages),
    ("source_mix", stages.mix_sources),
    ("packing", stages.pack_sequences),
]

#: Tokenizers, trained scores and MinHash are beyond SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage reads what the one before it wrote."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
