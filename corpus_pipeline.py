"""The corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The first four return the columns of
``docs``; the last one returns the mix, a row for each time that a document is taken, with ``mix_pass`` and
``mix_finish`` (its place in the order) added.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cairnflow.llm import decontamination, mixing, near_dedup, quality_rules, substring_dedup
from cairnflow.llm.common import table
from cairnflow.session import prepare, shared_folder


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_dedup.keep_first(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return substring_dedup.remove_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mixed(docs)


STAGES = [
    ("quality rules", apply_quality_rules),
    ("near-duplicates", drop_near_duplicates),
    ("substring dedup", remove_repeated_passages),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


# Signatures, the forest and the order of the mix are not expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None
