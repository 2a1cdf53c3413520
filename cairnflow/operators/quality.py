"""Data-quality checks. Each returns the violating rows; ``enforce`` turns them into an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.functions.text import is_blank
from cairnflow.operators.filters import same_metadata
from cairnflow.schemas import SIMILARITY_TOLERANCE, TREND_STATUSES


def enforce(violations: DataFrame, what: str) -> None:
    """Raise when there is a violation; shows one example and looks at no more."""
    example = violations.head(1)
    if example:
        raise ValueError(f"{what}: {example[0].asDict()}")


def _tagged(df: DataFrame, rules: dict, *keep: str) -> DataFrame:
    """One row per broken rule: a single pass evaluates all of them."""
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return df.select(*keep, F.explode(broken).alias("rule"))


def item_violations(items: DataFrame) -> DataFrame:
    """Row constraints of the item table as ``(id, rule)``."""
    problem, vector, model = F.col("is_problem"), F.col("embedding"), F.col("embedding_model")
    facts = [F.col(c).isNull() for c in ("problem_confidence", "problem_reason", "problem_classifier", "classified_at")]
    any_missing = facts[0] | facts[1] | facts[2] | facts[3]
    all_missing = facts[0] & facts[1] & facts[2] & facts[3]
    rules = {
        "embedding and model come together": vector.isNull() != model.isNull(),
        "model is not blank": model.isNotNull() & is_blank(model),
        "verdict and its facts come together": F.when(problem.isNull(), ~all_missing).otherwise(any_missing),
        "confidence is between 0 and 1": ~F.col("problem_confidence").between(0.0, 1.0),
        "only problems are embedded": vector.isNotNull() & ~F.coalesce(problem, F.lit(False)),
    }
    return _tagged(items, rules, "id")


def repeated(df: DataFrame, *key: str) -> DataFrame:
    """Keys that are not unique, with their count."""
    return df.groupBy(*key).agg(F.count("*").alias("occurrences")).filter(F.col("occurrences") > 1)


def classification_violations(results: DataFrame, *keep: str) -> DataFrame:
    """Verdicts that may not be stored as ``(keep..., rule)``."""
    confidence = F.col("confidence")
    rules = {
        "is_problem is set": F.col("is_problem").isNull(),
        "confidence is a finite number between 0 and 1": confidence.isNull() | ~confidence.between(0.0, 1.0),
        "reason is not blank": is_blank(F.col("reason")),
        "classifier_name is not blank": is_blank(F.col("classifier_name")),
    }
    return _tagged(results, rules, *keep)


def coverage_violations(rows: DataFrame, clusters: DataFrame, key: str) -> DataFrame:
    """Clusters that ``rows`` does not cover exactly once: missing, repeated or unknown.

    Both sides are counted per id before they meet, so nothing multiplies.
    """
    have = rows.groupBy(F.col(key).alias("cluster_id")).agg(F.count("*").alias("occurrences"))
    want = clusters.select("cluster_id").distinct().withColumn("wanted", F.lit(True))
    problem = (
        F.when(F.col("wanted").isNull(), "unknown")
        .when(F.col("occurrences").isNull(), "missing")
        .when(F.col("occurrences") > 1, "repeated")
    )
    return (
        want.join(have, "cluster_id", "full_outer")
        .select("cluster_id", problem.alias("problem"))
        .filter(F.col("problem").isNotNull())
    )


def match_violations(matches: DataFrame, current: DataFrame, previous: DataFrame) -> DataFrame:
    """Broken rules of matching results as ``(current_cluster_id, rule)``."""
    now = current.select(F.col("cluster_id").alias("current_cluster_id"), F.lit(True).alias("has_current"))
    before = previous.select(F.col("cluster_id").alias("previous_cluster_id"), F.lit(True).alias("has_previous"))
    uses = (
        matches.filter(F.col("previous_cluster_id").isNotNull())
        .groupBy("previous_cluster_id")
        .agg(F.count("*").alias("uses"))
    )
    rows = matches.groupBy("current_cluster_id").agg(F.count("*").alias("rows"))
    joined = (
        matches.join(now, "current_cluster_id", "left")
        .join(before, "previous_cluster_id", "left")
        .join(uses, "previous_cluster_id", "left")
        .join(rows, "current_cluster_id", "left")
    )
    matched, similarity = F.col("previous_cluster_id").isNotNull(), F.col("similarity")
    limit = 1.0 + SIMILARITY_TOLERANCE
    rules = {
        "unknown current cluster": F.col("has_current").isNull(),
        "unknown previous cluster": matched & F.col("has_previous").isNull(),
        "current cluster matched twice": F.col("rows") > 1,
        "previous cluster matched twice": F.col("uses") > 1,
        "matched clusters have status matched and a similarity": matched
        & ((F.col("status") != "matched") | similarity.isNull()),
        "unmatched clusters have status new": ~matched & (F.col("status") != "new"),
        "similarity is a cosine": F.isnan(similarity) | ~similarity.between(-limit, limit),
    }
    return _tagged(joined, rules, "current_cluster_id")


def trend_violations(trends: DataFrame, clusters: DataFrame, previous_clusters: DataFrame) -> DataFrame:
    """Rules a trend row breaks before it may be saved, as ``(current_cluster_id, rule)``."""
    now = clusters.select(
        F.col("cluster_id").alias("current_cluster_id"), F.col("document_count").alias("documents")
    )
    before = previous_clusters.select(
        F.col("cluster_id").alias("previous_cluster_id"), F.lit(True).alias("has_previous")
    )
    rows = trends.groupBy("current_cluster_id").agg(F.count("*").alias("rows"))
    joined = (
        trends.join(now, "current_cluster_id", "left")
        .join(before, "previous_cluster_id", "left")
        .join(rows, "current_cluster_id", "left")
    )
    alone, similarity = F.col("previous_cluster_id").isNull(), F.col("similarity")
    limit = 1.0 + SIMILARITY_TOLERANCE
    rules = {
        "cluster has one trend": F.col("rows") > 1,
        "clusters without a previous one are new": alone & (F.col("status") != "new"),
        "clusters with a previous one are not new": ~alone & (F.col("status") == "new"),
        "clusters without a previous one have no previous count": alone & (F.col("previous_count") != 0),
        "similarity comes with a previous cluster": alone != similarity.isNull(),
        "similarity is a cosine": F.isnan(similarity) | ~similarity.between(-limit, limit),
        "change is the difference of the counts": F.col("absolute_change") != F.col("current_count") - F.col("previous_count"),
        "unknown current cluster": F.col("documents").isNull(),
        "unknown previous cluster": F.col("previous_cluster_id").isNotNull() & F.col("has_previous").isNull(),
        "unknown status": ~F.col("status").isin(*TREND_STATUSES),
        "count equals the cluster's": F.col("current_count") != F.col("documents"),
        "counts are not negative": (F.col("current_count") < 0) | (F.col("previous_count") < 0),
        "growth is finite": F.isnan("growth_rate") | (F.abs("growth_rate") == float("inf")),
    }
    missing = now.join(trends.select("current_cluster_id").distinct(), "current_cluster_id", "left_anti")
    absent = missing.select("current_cluster_id", F.lit("cluster has a trend").alias("rule"))
    return _tagged(joined, rules, "current_cluster_id").unionByName(absent)


def ranking_violations(rankings: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rules a ranking breaks against its clusters, as ``(cluster_id, rule)``."""
    own = clusters.select("cluster_id", F.col("label").alias("own_label"), F.col("document_count").alias("own_count"))
    ranks = rankings.groupBy("rank").agg(F.count("*").alias("sharing"))
    rows = rankings.groupBy("cluster_id").agg(F.count("*").alias("rows"))
    joined = rankings.join(own, "cluster_id", "left").join(ranks, "rank", "left").join(rows, "cluster_id", "left")
    rules = {
        "unknown cluster": F.col("own_count").isNull(),
        "label equals the cluster's": ~F.col("label").eqNullSafe(F.col("own_label")) & F.col("own_count").isNotNull(),
        "count equals the cluster's": F.col("document_count") != F.col("own_count"),
        "rank is positive": F.col("rank") <= 0,
        "rank is unique": F.col("sharing") > 1,
        "cluster has one rank": F.col("rows") > 1,
        "growth is finite": F.isnan("growth_rate") | (F.abs("growth_rate") == float("inf")),
    }
    missing = own.join(rankings.select("cluster_id").distinct(), "cluster_id", "left_anti")
    return _tagged(joined, rules, "cluster_id").unionByName(missing.select("cluster_id", F.lit("cluster is ranked").alias("rule")))


def history_violations(history: DataFrame, latest: DataFrame) -> DataFrame:
    """Runs that may not share a series with the latest run (one row), as ``(id, rule)``."""
    counts = ("total_problems", "cluster_count", *[f"{s}_count" for s in TREND_STATUSES])
    negative = F.lit(False)
    for c in counts:
        negative = negative | (F.col(c) < 0)
    uses = history.groupBy("id").agg(F.count("*").alias("uses"))
    compatible = history.alias("h").join(latest.alias("l"), same_metadata("h", "l"), "left_semi")
    flagged = (
        history.join(uses, "id")
        .join(compatible.select("id", F.lit(True).alias("fits")).distinct(), "id", "left")
    )
    rules = {
        "run is repeated": F.col("uses") > 1,
        "counts are not negative": negative,
        "metadata equals the latest run's": F.col("fits").isNull(),
    }
    return _tagged(flagged, rules, "id")


def membership_violations(clusters: DataFrame, members: DataFrame, items: DataFrame, run_id: int) -> DataFrame:
    """Clusters of another run, without members, or mixing embedding models, as ``(cluster_id, rule)``."""
    models = items.select(F.col("id").alias("item_id"), "embedding_model")
    # Two-step distinct: the map side shrinks a huge cluster to one row per model.
    per_cluster = (
        members.join(models, "item_id", "left")
        .groupBy("cluster_id", "embedding_model")
        .agg(F.count("*").alias("n"))
        .groupBy("cluster_id")
        .agg(F.count("embedding_model").alias("models"), F.sum("n").alias("documents"))
    )
    joined = clusters.select("cluster_id", "run_id").join(per_cluster, "cluster_id", "left")
    rules = {
        "cluster belongs to the run": F.col("run_id") != run_id,
        "cluster is not empty": F.col("documents").isNull(),
        "cluster uses one model": F.col("models") != 1,
    }
    return _tagged(joined, rules, "cluster_id")
