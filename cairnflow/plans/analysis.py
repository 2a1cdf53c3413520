"""One analysis run: cluster, label, match to the previous compatible run, detect trends, store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.operators import aggregates, density, matching, quality, topics, trends
from cairnflow.plans.store import RunStore
from cairnflow.schemas import CHANGE_THRESHOLD, CLUSTER_ITEMS, CLUSTERS, SIMILARITY_THRESHOLD
from cairnflow.session import materialize


@dataclass(frozen=True)
class Parameters:
    embedding_model: str
    min_cluster_size: int = density.MIN_CLUSTER_SIZE
    min_samples: int | None = None
    metric: str = "euclidean"
    similarity_threshold: float = SIMILARITY_THRESHOLD
    change_threshold: float = CHANGE_THRESHOLD
    max_keywords: int = topics.MAX_KEYWORDS

    @property
    def metadata(self) -> dict:
        return {
            "embedding_model": self.embedding_model,
            "min_cluster_size": self.min_cluster_size,
            "min_samples": self.min_samples,
            "metric": self.metric,
        }


def cluster_id(run_id: int, local):
    """A key that is unique over runs."""
    return F.shiftleft(F.lit(run_id).cast("long"), 32) + local.cast("long")


def analyse(items: DataFrame, store: RunStore, parameters: Parameters, created_at=None) -> int:
    """Run the analysis over the embedded problems of one model and return the new run's id.

    The header is committed last: a failure at any point leaves no visible run. Without clusters an
    empty run is recorded, and the first run of its kind marks all clusters new.
    """
    run_id = store.next_run_id()
    local = materialize(
        density.cluster_items(
            items,
            parameters.embedding_model,
            min_cluster_size=parameters.min_cluster_size,
            min_samples=parameters.min_samples,
            metric=parameters.metric,
        ),
        "assignment",
    )
    members = store.write(
        "members",
        run_id,
        local.select(
            F.lit(run_id).alias("run_id"),
            cluster_id(run_id, F.col("cluster_id")).alias("cluster_id"),
            F.col("item_id").alias("source_item_id"),
        ),
        CLUSTER_ITEMS,
    )
    facts = items.select(F.col("id").alias("source_item_id"), "document_text", "embedding")
    documents = members.join(facts, "source_item_id").withColumnRenamed("source_item_id", "item_id")
    labels = materialize(topics.label_clusters(documents.select("cluster_id", "item_id", "document_text"), parameters.max_keywords), "labels")
    quality.enforce(topics.unlabelled(documents, labels), "cluster cannot be labelled")
    local_id = F.col("cluster_id") - F.shiftleft(F.lit(run_id).cast("long"), 32)
    rows = (
        aggregates.document_counts(members)
        .join(aggregates.centroids(documents), "cluster_id")
        .join(labels, "cluster_id")
        .select(
            F.col("cluster_id").alias("id"),
            F.lit(run_id).alias("run_id"),
            local_id.alias("local_cluster_id"),
            "label",
            "keywords",
            "centroid",
            "document_count",
            F.current_timestamp().alias("created_at"),
        )
    )
    clusters = store.write("clusters", run_id, rows, CLUSTERS).withColumnRenamed("id", "cluster_id")
    previous = store.previous_run(parameters.metadata, excluding=run_id)
    if previous is None:
        before = clusters.limit(0)
    else:
        before = store.clusters(previous["id"]).withColumnRenamed("id", "cluster_id")
    matches = matching.match_clusters(clusters, before, parameters.similarity_threshold)
    quality.enforce(quality.match_violations(matches, clusters, before), "invalid match")
    found = trends.detect_trends(clusters, before, matches, parameters.change_threshold)
    store.save_trends(run_id, found, None if previous is None else previous["id"], parameters.metadata)
    store.commit(run_id, parameters.metadata, created_at)
    return run_id


def summary(items: DataFrame, store: RunStore, run_id: int) -> DataFrame:
    """Available, embedded, assigned, noise and status counts of a stored run."""
    return aggregates.analysis_summary(items, store.members(run_id), store.trends(run_id))
