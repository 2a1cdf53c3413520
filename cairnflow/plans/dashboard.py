"""The query surface over stored runs: summary, opportunities, clusters, details, trends, search.

``Snapshot`` holds the tables a query may touch; every function is one lazy plan over them, so the
optimizer pushes the run filter and the projection into the scans. Rankings see all clusters of the
run, and the time series reads the real run history.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.operators import aggregates, filters, search
from cairnflow.operators.ranking import rank_opportunities


@dataclass(frozen=True)
class Snapshot:
    """Tables of one run plus the item table and the run history.

    ``clusters``: cluster_id, run_id, label, keywords, document_count. ``members``: cluster_id,
    item_id. ``trends``: current_cluster_id, status, growth_rate, ... ``runs``: id, created_at.
    ``history``: one row per compatible run with the series measures.
    """

    items: DataFrame
    clusters: DataFrame
    members: DataFrame
    trends: DataFrame
    runs: DataFrame
    history: DataFrame


def ranked_clusters(snapshot: Snapshot) -> DataFrame:
    statistics = aggregates.cluster_statistics(snapshot.members, snapshot.items)
    inputs = snapshot.clusters.select("cluster_id", "label", "keywords", "document_count").join(statistics, "cluster_id")
    return rank_opportunities(inputs, snapshot.trends)


def breakdown(snapshot: Snapshot) -> DataFrame:
    return aggregates.source_breakdown(aggregates.problems_per_source(snapshot.items))


def summary(snapshot: Snapshot) -> DataFrame:
    return aggregates.dashboard_summary(
        breakdown(snapshot), snapshot.clusters, snapshot.trends, snapshot.runs
    )


PUBLIC_RANKING = (
    "cluster_id",
    "label",
    "rank",
    "opportunity_score",
    "document_count",
    "growth_rate",
    "status",
    "source_count",
    "average_problem_confidence",
    "keywords",
)


def opportunities(snapshot: Snapshot, limit: int = 20, status: str | None = None) -> DataFrame:
    ranked = filters.with_status(ranked_clusters(snapshot), status).select(*PUBLIC_RANKING)
    return filters.top_opportunities(ranked, filters.page_limit(limit))


def clusters(
    snapshot: Snapshot,
    limit: int = 20,
    offset: int = 0,
    status: str | None = None,
    sort_by: str = "document_count",
    order: str = "desc",
) -> DataFrame:
    ranked = filters.with_status(ranked_clusters(snapshot), status).select(*PUBLIC_RANKING)
    return filters.cluster_page(ranked, limit, offset, sort_by, order)


def cluster_documents(snapshot: Snapshot, cluster_id: int, limit: int = 20) -> DataFrame:
    """Public documents of a cluster, newest first."""
    wanted = snapshot.members.filter(F.col("cluster_id") == cluster_id).select(F.col("item_id").alias("id"))
    documents = snapshot.items.join(wanted, "id")
    return filters.public_documents(filters.newest_documents(documents, filters.page_limit(limit)))


def cluster_detail(snapshot: Snapshot, cluster_id: int, document_limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """The ranked cluster (no row when unknown) and its documents."""
    cluster = ranked_clusters(snapshot).filter(F.col("cluster_id") == cluster_id).select(*PUBLIC_RANKING)
    return cluster, cluster_documents(snapshot, cluster_id, document_limit)


def trends(snapshot: Snapshot, period: str = "day", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The status distribution of the run and the series over the run history."""
    series = aggregates.run_series(snapshot.history, period)
    if limit is not None:
        series = filters.last_periods(series, filters.page_limit(limit))
    return aggregates.trend_distribution(snapshot.trends), series


def search_problems(snapshot: Snapshot, vector: list[float], model: str, limit: int = 20) -> DataFrame:
    return search.search_one(snapshot.items, vector, filters.page_limit(limit), model)


def search_text(snapshot: Snapshot, question: str, encode_text, model: str, limit: int = 20) -> DataFrame:
    """Encode a non-blank question with ``encode_text`` (text to list of floats), then search."""
    if not isinstance(question, str) or not question.strip():
        raise ValueError("the question must not be blank")
    return search_problems(snapshot, encode_text(question.strip()), model, limit)


def analytics(snapshot: Snapshot, period: str = "day", top: int = 10) -> dict[str, DataFrame]:
    """Everything the dashboard shows for the latest run, one DataFrame per part."""
    distribution, series = trends(snapshot, period)
    return {
        "summary": summary(snapshot),
        "top_opportunities": filters.top_opportunities(ranked_clusters(snapshot).select(*PUBLIC_RANKING), top),
        "source_breakdown": breakdown(snapshot),
        "trend_distribution": distribution,
        "time_series": series,
    }
