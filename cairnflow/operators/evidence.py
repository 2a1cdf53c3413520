"""What stands behind a cluster, and posts that are one and the same: optional parts of the data model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnflow.functions.checks import row_limit
from cairnflow.functions.vectors import cosine_similarity
from cairnflow.operators.coverage import market_coverage
from cairnflow.schemas import COVERAGE_PARTIAL, COVERAGE_SATURATED, COVERAGE_UNCOVERED
from cairnflow.sources.scopes import one_of

COVERAGES = (COVERAGE_UNCOVERED, COVERAGE_PARTIAL, COVERAGE_SATURATED)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, without fragment, tracking parameters and closing slashes."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, r"(?<=[?&])utm_[^&]*&?", "")
    bare = F.regexp_replace(bare, r"[?&/]+$", "")
    host = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0)
    return F.concat(F.lower(host), F.substr(bare, F.length(host) + 1))


def duplicates(rows: DataFrame, key: Column, reason: str, id_column: str = "id") -> DataFrame:
    """``(id, kept_id, copies, reason)`` of every row whose key others have too; the least id is the one to keep.

    Keys are counted before they meet the rows, so a key that very many rows share is one short row on that side.
    """
    keyed = rows.select(F.col(id_column).alias("id"), key.alias("key")).filter(F.col("key").isNotNull())
    groups = keyed.groupBy("key").agg(F.min("id").alias("kept_id"), F.count("*").alias("copies")).filter("copies > 1")
    return keyed.join(groups, "key").select("id", "kept_id", "copies", F.lit(reason).alias("reason"))


def citations(members: DataFrame, items: DataFrame) -> DataFrame:
    """First and last publication time of each cluster's documents."""
    dated = members.join(items.select(F.col("id").alias("item_id"), "published_at"), "item_id")
    return dated.groupBy("cluster_id").agg(F.min("published_at").alias("first_cited"), F.max("published_at").alias("last_cited"))


def source_split(members: DataFrame, items: DataFrame) -> DataFrame:
    """Documents of each cluster by source, and their share of the cluster."""
    counts = (
        members.join(items.select(F.col("id").alias("item_id"), "source"), "item_id")
        .groupBy("cluster_id", "source")
        .agg(F.count("*").alias("documents"))
    )
    # One row per cluster and source: the window sees counts, not documents.
    share = F.col("documents") / F.sum("documents").over(Window.partitionBy("cluster_id"))
    return counts.withColumn("share", share)


def representatives(members: DataFrame, items: DataFrame, centroids: DataFrame, most: int = 3) -> DataFrame:
    """The documents nearest to the centroid of their cluster: ``(cluster_id, item_id, similarity, place)``.

    The limit on the rank is applied before the shuffle as well, so few rows of a large cluster meet in one task.
    """
    most = row_limit(most, "most")
    vectors = items.filter(F.col("embedding").isNotNull()).select(F.col("id").alias("item_id"), F.col("embedding").alias("vector"))
    near = (
        members.select("cluster_id", "item_id")
        .join(vectors, "item_id")
        .join(centroids.select("cluster_id", "centroid"), "cluster_id")
        .select("cluster_id", "item_id", F.round(cosine_similarity(F.col("vector"), F.col("centroid")), 9).alias("similarity"))
    )
    order = Window.partitionBy("cluster_id").orderBy(F.col("similarity").desc(), "item_id")
    return near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def filtered_clusters(
    clusters: DataFrame,
    members: DataFrame,
    items: DataFrame,
    sources: Sequence[str] | None = None,
    since: Column | None = None,
    until: Column | None = None,
    min_size: int | None = None,
    coverage: Sequence[str] | None = None,
    solutions: DataFrame | None = None,
) -> DataFrame:
    """Clusters with ``matching``, their documents of these sources published in [since, until).

    Clusters without such a document are left out, clusters smaller than ``min_size`` documents in all, and those whose
    market coverage by ``solutions`` (cluster_id, ...) is not among ``coverage``.
    """
    wanted = items
    if sources is not None:
        wanted = wanted.filter(F.col("source").isin(*sources))
    if since is not None:
        wanted = wanted.filter(F.col("published_at") >= since)
    if until is not None:
        wanted = wanted.filter(F.col("published_at") < until)
    counts = members.join(wanted.select(F.col("id").alias("item_id")), "item_id").groupBy("cluster_id").agg(F.count("*").alias("matching"))
    found = clusters.join(counts, "cluster_id")
    if coverage is not None:
        if solutions is None:
            raise ValueError("a coverage filter needs the solutions")
        kept = [one_of(status, COVERAGES, "coverage") for status in coverage]
        covered = market_coverage(clusters, solutions).filter(F.col("coverage").isin(*kept)).select("cluster_id")
        found = found.join(covered, "cluster_id", "left_semi")
    return found if min_size is None else found.filter(F.col("document_count") >= row_limit(min_size, "min_size"))


def success_metrics(items: DataFrame, members: DataFrame, solutions: DataFrame | None = None) -> DataFrame:
    """One row: documents, the share of problems with a vector, of documents with a link, the clusters, and with
    ``solutions`` the share of clusters that have a known one."""
    named = members.select("cluster_id").distinct()
    row = items.agg(
        F.count("*").alias("documents"),
        F.try_divide(F.count_if(F.col("is_problem") & F.col("embedding").isNotNull()), F.count_if("is_problem")).alias("embedding_coverage"),
        F.try_divide(F.count_if(F.trim("url") != ""), F.count("*")).alias("link_coverage"),
    )
    if solutions is None:
        return row.crossJoin(F.broadcast(named.agg(F.count("*").alias("clusters"))))
    covered = market_coverage(named, solutions).agg(
        F.count("*").alias("clusters"), F.try_divide(F.count_if(F.col("solution_count") > 0), F.count("*")).alias("market_coverage")
    )
    return row.crossJoin(F.broadcast(covered))
