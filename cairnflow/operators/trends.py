"""How each matched cluster changed since the previous run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.functions.numbers import growth_rate, trend_status, validate_change_threshold
from cairnflow.schemas import CHANGE_THRESHOLD


def detect_trends(
    current: DataFrame, previous: DataFrame, matches: DataFrame, threshold: float = CHANGE_THRESHOLD
) -> DataFrame:
    """Trend rows of ``current`` (cluster_id, label, document_count) against the matched clusters."""
    threshold = validate_change_threshold(threshold)
    before = previous.select(
        F.col("cluster_id").alias("previous_cluster_id"), F.col("document_count").alias("before")
    )
    paired = (
        current.select(F.col("cluster_id").alias("current_cluster_id"), "label", F.col("document_count").alias("current_count"))
        .join(matches.select("current_cluster_id", "previous_cluster_id", "similarity"), "current_cluster_id")
        .join(before, "previous_cluster_id", "left")
    )
    matched = F.col("previous_cluster_id").isNotNull()
    change = F.col("current_count") - F.col("previous_count")
    return (
        paired.withColumn("previous_count", F.coalesce("before", F.lit(0)))
        .withColumn("absolute_change", change)
        .withColumn("growth_rate", F.when(matched, growth_rate(F.col("current_count"), F.col("previous_count"))))
        .select(
            "current_cluster_id",
            "previous_cluster_id",
            "label",
            "current_count",
            "previous_count",
            "absolute_change",
            "growth_rate",
            trend_status(matched, F.col("absolute_change"), F.col("growth_rate"), threshold).alias("status"),
            F.when(matched, F.col("similarity")).alias("similarity"),
        )
    )
