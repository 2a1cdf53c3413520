"""Predicates, projections, ordered pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.functions.vectors import distance_to
from cairnflow.schemas import RUN_METADATA, TREND_STATUSES
from cairnflow.sources.scopes import one_of, positive_limit


def problems(items: DataFrame) -> DataFrame:
    """Problem posts; unclassified ones (NULL) are not problems."""
    return items.filter("is_problem")


def vector_space(items: DataFrame, model: str) -> DataFrame:
    """Problems embedded by one model, in id order."""
    if not model.strip():
        raise ValueError("model must not be blank")
    return items.filter(
        F.col("is_problem") & F.col("embedding").isNotNull() & (F.col("embedding_model") == model.strip())
    ).orderBy("id")


def pending_embedding(items: DataFrame) -> DataFrame:
    return items.filter(F.col("is_problem") & F.col("embedding").isNull()).orderBy("id")


def of_run(table: DataFrame, run_id: int, cluster_id: int | None = None) -> DataFrame:
    rows = table.filter(F.col("run_id") == run_id)
    return rows if cluster_id is None else rows.filter(F.col("cluster_id") == cluster_id)


def same_metadata(left: str, right: str) -> Column:
    """Runs are compatible when model and parameters agree; NULL parameters agree with NULL."""
    tests = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in RUN_METADATA]
    condition = tests[0]
    for test in tests[1:]:
        condition = condition & test
    return condition


def compatible_runs(runs: DataFrame, metadata: dict) -> DataFrame:
    condition = F.lit(True)
    for column in RUN_METADATA:
        condition = condition & F.col(column).eqNullSafe(F.lit(metadata[column]))
    return runs.filter(condition)


def with_status(ranked: DataFrame, status: str | None) -> DataFrame:
    if status is None:
        return ranked
    return ranked.filter(F.col("status") == one_of(status, TREND_STATUSES, "status"))


def without_noise(labels: DataFrame) -> DataFrame:
    return labels.filter(F.col("cluster_id") != -1)


def public_documents(items: DataFrame) -> DataFrame:
    """What may leave the system: no payload, no vector; a missing confidence reads as 0."""
    hidden = {"raw_payload", "embedding", "centroid"}
    shown = [c for c in items.columns if c not in hidden and c != "problem_confidence"]
    return items.select(*shown, F.coalesce("problem_confidence", F.lit(0.0)).alias("problem_confidence"))


# Fixed value: the columns a cluster page may be sorted by.
CLUSTER_SORTS = ("document_count", "opportunity_score", "growth_rate")


def page_limit(limit: int) -> int:
    if not 1 <= positive_limit(limit) <= 100:
        raise ValueError("limit must be between 1 and 100")
    return limit


def cluster_page(
    ranked: DataFrame,
    limit: int = 20,
    offset: int = 0,
    sort_by: str = "document_count",
    order: str = "desc",
) -> DataFrame:
    """A sorted page; a missing growth rate sorts below all, ties go by cluster id ascending."""
    column = F.col(one_of(sort_by, CLUSTER_SORTS, "sort_by"))
    if offset < 0:
        raise ValueError("offset must not be negative")
    key = {"desc": column.desc_nulls_last(), "asc": column.asc_nulls_first()}[one_of(order, ("asc", "desc"), "order")]
    return ranked.orderBy(key, F.col("cluster_id").asc()).offset(offset).limit(page_limit(limit))


def top_opportunities(ranked: DataFrame, limit: int = 10) -> DataFrame:
    return ranked.orderBy("rank", "cluster_id").limit(positive_limit(limit))


def newest_documents(documents: DataFrame, limit: int) -> DataFrame:
    return documents.orderBy(F.col("published_at").desc(), F.col("id").asc()).limit(positive_limit(limit))


def last_periods(series: DataFrame, limit: int) -> DataFrame:
    """The newest periods, still oldest first."""
    return series.orderBy(F.col("period_start").desc()).limit(positive_limit(limit)).orderBy("period_start")


def nearest(items: DataFrame, vector: list[float], limit: int, model: str) -> DataFrame:
    """The closest problems of a model to one vector by cosine distance; ties go by id.

    A scan with one matrix product per Arrow batch and a bounded heap per task: only ids and vectors travel to Python, and
    nothing is shuffled but ``limit`` rows per task. The other columns of the answers are fetched by id afterwards.
    """
    space = items.filter(
        F.col("is_problem") & F.col("embedding").isNotNull() & (F.col("embedding_model") == model)
    )
    near = space.select("id", distance_to(F.col("embedding"), vector).alias("distance")).orderBy("distance", "id").limit(positive_limit(limit))
    return space.join(F.broadcast(near), "id").orderBy("distance", "id")
