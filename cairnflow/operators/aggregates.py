"""Counts, statistics and time series."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.functions.numbers import period_start, ratio
from cairnflow.schemas import TREND_STATUSES
from cairnflow.session import materialize


def problems_per_source(items: DataFrame) -> DataFrame:
    return items.filter("is_problem").groupBy("source").agg(F.count("*").alias("problem_count")).orderBy("source")


def cluster_statistics(members: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct sources and mean confidence per cluster.

    Grouping by (cluster, source) first lets the map side shrink even a cluster that holds most of
    the documents to one row per source; the second step then counts rows instead of a distinct.
    """
    joined = members.join(items.select(F.col("id").alias("item_id"), "source", "problem_confidence"), "item_id")
    per_source = joined.groupBy("cluster_id", "source").agg(
        F.sum("problem_confidence").alias("confidence"), F.count("problem_confidence").alias("judged")
    )
    return per_source.groupBy("cluster_id").agg(
        F.count("source").alias("source_count"),
        ratio(F.sum("confidence"), F.sum("judged")).alias("average_problem_confidence"),
    )


def document_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster_id").agg(F.count("*").alias("document_count"))


def source_breakdown(counts: DataFrame) -> DataFrame:
    """Share of all problems per source with at least one; the last row takes the rounding residue."""
    # One short row per source, written once because three totals and the rows themselves read it.
    positive = materialize(counts.filter(F.col("problem_count") > 0), "sources")
    total = positive.agg(F.sum("problem_count")).scalar()
    shares = positive.select(
        "source", "problem_count", ratio(F.col("problem_count"), total).alias("share")
    )
    # The last source in (-count, source) order.
    last = positive.agg(F.max_by("source", F.struct(-F.col("problem_count"), F.col("source")))).scalar()
    residue = shares.agg(1.0 - F.sum("share")).scalar()
    return shares.select(
        "source",
        "problem_count",
        (F.col("share") + F.when(F.col("source") == last, residue).otherwise(0.0)).alias("percentage"),
    ).orderBy(F.col("problem_count").desc(), "source")


def trend_distribution(trends: DataFrame) -> DataFrame:
    """One row with a count for each status, zeros included."""
    return trends.agg(
        *[F.count_if(F.col("status") == status).alias(f"{status}_count") for status in TREND_STATUSES]
    )


def dashboard_summary(
    breakdown: DataFrame, clusters: DataFrame, trends: DataFrame, runs: DataFrame
) -> DataFrame:
    """One row, also when there is no run yet (then all zeros and NULLs)."""
    problems = breakdown.agg(
        F.struct(F.sum("problem_count").alias("problems"), F.count("*").alias("sources"))
    ).scalar()
    latest = runs.agg(F.max(F.struct("created_at", "id"))).scalar()
    cluster_count = clusters.agg(F.count("*")).scalar()
    facts = trend_distribution(trends).select(
        "*", problems.alias("problems"), latest.alias("latest"), cluster_count.alias("total_clusters")
    )
    return facts.select(
        F.coalesce("problems.problems", F.lit(0)).alias("total_problems"),
        "total_clusters",
        *[F.col(f"{status}_count").alias(f"{status}_clusters") for status in TREND_STATUSES],
        F.coalesce("problems.sources", F.lit(0)).alias("source_count"),
        F.col("latest.id").alias("latest_run_id"),
        F.col("latest.created_at").alias("latest_run_created_at"),
    )


HISTORY_MEASURES = ("total_problems", "cluster_count") + tuple(f"{s}_count" for s in TREND_STATUSES)


def run_series(history: DataFrame, granularity: str) -> DataFrame:
    """Sums of the run history per period; periods without a run do not appear."""
    return (
        history.groupBy(period_start(F.col("created_at"), granularity).alias("period_start"))
        .agg(*[F.sum(measure).alias(measure) for measure in HISTORY_MEASURES])
        .orderBy("period_start")
    )


def centroids(members: DataFrame) -> DataFrame:
    """Element-wise mean of the member vectors per cluster, ``(cluster_id, centroid)``.

    A vector aggregate: partial means are combined before the shuffle, so a cluster that holds most
    of the documents still costs one vector per task.
    """
    vectors = members.select("cluster_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("vector"))
    return vectors.groupBy("cluster_id").agg(
        vector_to_array(Summarizer.mean(F.col("vector"))).alias("centroid")
    )


def confusion(predictions: DataFrame) -> DataFrame:
    """Counts and accuracy, precision, recall, F1 of boolean ``expected`` against ``predicted``."""
    expected, predicted = F.col("expected"), F.col("predicted")
    counts = predictions.agg(
        F.count_if(predicted & expected).alias("true_positives"),
        F.count_if(~predicted & ~expected).alias("true_negatives"),
        F.count_if(predicted & ~expected).alias("false_positives"),
        F.count_if(~predicted & expected).alias("false_negatives"),
    )
    tp, tn, fp, fn = (F.col(c) for c in counts.columns)
    rates = counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + tn + fp + fn),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    return rates.withColumn("f1_score", ratio(2 * p * r, p + r))


def misclassified(predictions: DataFrame) -> DataFrame:
    return predictions.filter(F.col("expected") != F.col("predicted"))


def ingestion_statistics(items: DataFrame) -> DataFrame:
    """Per source and in total (source NULL): acquired, problems, non-problems, embedded, malformed."""
    return items.rollup("source").agg(
        F.count("*").alias("acquired"),
        F.count_if("is_problem").alias("problems"),
        F.count_if(~F.col("is_problem")).alias("non_problems"),
        F.count_if(F.col("embedding").isNotNull()).alias("embedded"),
        F.count_if("malformed").alias("malformed"),
    )


def insertion_statistics(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Per source and in total: acquired rows, keys new to the table, rows already known."""
    key = ["source", "external_id"]
    known = existing.select(*key, F.lit(True).alias("known"))
    per_key = batch.groupBy(*key).agg(F.count("*").alias("rows")).join(known, key, "left")
    return per_key.rollup("source").agg(
        F.sum("rows").alias("acquired"),
        F.count_if(F.col("known").isNull()).alias("new_items"),
        (F.sum("rows") - F.count_if(F.col("known").isNull())).alias("existing_items"),
    )


def analysis_summary(items: DataFrame, members: DataFrame, trends: DataFrame) -> DataFrame:
    """Problems available, embedded, assigned to a cluster, left as noise, and clusters by status."""
    # One row each, from one pass over either table.
    assigned = members.agg(F.count("*").alias("assigned"))
    by_status = trends.agg(*[F.count_if(F.col("status") == s).alias(f"{s}_clusters") for s in TREND_STATUSES])
    return (
        items.filter("is_problem")
        .agg(
            F.count("*").alias("available"),
            F.count_if(F.col("embedding").isNotNull()).alias("embedded"),
        )
        .crossJoin(F.broadcast(assigned))
        .crossJoin(F.broadcast(by_status))
        .select(
            "available",
            "embedded",
            "assigned",
            (F.col("embedded") - F.col("assigned")).alias("noise"),
            *by_status.columns,
        )
    )
