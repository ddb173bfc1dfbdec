"""A training corpus from ``documents``: five stages, each written to the shared folder before the next reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.base import small_batches, table
from riskloom.llm.stages import known_language, mixed, one_of_each_group, uncontaminated, without_repeats
from riskloom.session import checkpoint_root

STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("repeated_strings", without_repeats),
    ("decontamination", uncontaminated),
    ("mixing", mixed),
]

# Neither the network nor the fingerprints can be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the stages leave, with ``topic``, ``tokens`` and ``mix_weight`` beside the columns of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_root(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        with small_batches(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
