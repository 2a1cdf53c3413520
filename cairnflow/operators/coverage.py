"""How well known solutions already cover a cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.schemas import COVERAGE_PARTIAL, COVERAGE_SATURATED, COVERAGE_UNCOVERED, SATURATED_FROM


def coverage_status(solution_count: Column) -> Column:
    return (
        F.when(solution_count == 0, COVERAGE_UNCOVERED)
        .when(solution_count < SATURATED_FROM, COVERAGE_PARTIAL)
        .otherwise(COVERAGE_SATURATED)
    )


def market_coverage(clusters: DataFrame, solutions: DataFrame) -> DataFrame:
    """``(cluster_id, solution_count, coverage)``; solutions are counted before the join."""
    counts = solutions.groupBy("cluster_id").agg(F.count("*").alias("found"))
    found = F.coalesce("found", F.lit(0))
    return clusters.select("cluster_id").join(counts, "cluster_id", "left").select(
        "cluster_id", found.alias("solution_count"), coverage_status(found).alias("coverage")
    )
