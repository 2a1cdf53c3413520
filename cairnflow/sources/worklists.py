"""Exchange of unclassified documents with an offline classifier, and keyed lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.session import is_there
from cairnflow.sources import records
from cairnflow.sources.scopes import positive_limit

KEY = ["source", "external_id"]


def unclassified(items: DataFrame, limit: int | None = None) -> DataFrame:
    """Documents nobody has classified, in key order, with the three exported columns."""
    rows = items.filter(F.col("is_problem").isNull()).select(*KEY, "document_text").orderBy(*KEY)
    return rows if limit is None else rows.limit(positive_limit(limit))


def export_unclassified(items: DataFrame, path: str, limit: int | None = None) -> DataFrame:
    """Write the export as JSON lines to a fresh folder; the commit protocol publishes it whole."""
    rows = unclassified(items, limit)
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)
    return items.sparkSession.read.text(path)


def pending(work: DataFrame, done: DataFrame) -> DataFrame:
    """Work whose key has no result yet."""
    return work.join(done.select(*KEY), KEY, "left_anti")


def append_results(spark: SparkSession, work: DataFrame, output: str, classify) -> DataFrame:
    """Classify what ``output`` lacks and append it; returns everything the output now holds.

    ``classify`` maps pending work items to classification rows. Re-running after a failure
    continues with the keys that are still missing.
    """
    if is_there(lambda: spark.read.text(output)):
        done = records.accepted(records.parse(records.read_lines(spark, output), records.CLASSIFICATION))
        duplicate = records.repeated_keys(done, *KEY)
        if not duplicate.isEmpty():
            raise ValueError("the output already holds a key twice")
        work = pending(work, done)
    rows = classify(work).select(*records.CLASSIFICATION.fields)
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(output)
    return records.accepted(records.parse(records.read_lines(spark, output), records.CLASSIFICATION))


def lookup(items: DataFrame, keys: DataFrame) -> DataFrame:
    """Items of the given ``(source, external_id)`` keys."""
    return items.join(keys.select(*KEY).distinct(), KEY, "left_semi")


def lookup_hash(items: DataFrame, hashes: DataFrame) -> DataFrame:
    """One item per given ``dedup_hash``: the lowest id that carries it."""
    wanted = items.join(hashes.select("dedup_hash").distinct(), "dedup_hash", "left_semi")
    row = F.struct(*items.columns)
    return wanted.groupBy("dedup_hash").agg(F.min_by(row, "id").alias("item")).select("item.*")


def known(items: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys with a flag telling whether an item exists."""
    present = items.select(*KEY).distinct().withColumn("_hit", F.lit(True))
    return keys.join(present, KEY, "left").select(
        *keys.columns, F.coalesce("_hit", F.lit(False)).alias("known")
    )
