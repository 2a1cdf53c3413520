"""TF-IDF keywords and labels of clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnflow.functions.stopwords import ENGLISH
from cairnflow.functions.text import is_blank, label_text, words
from cairnflow.operators.skew import join_by_weight
from cairnflow.session import materialize
from cairnflow.sources.scopes import positive_limit

MAX_KEYWORDS = 5


def document_terms(documents: DataFrame, stop_words: Sequence[str] | None = None) -> DataFrame:
    """``(cluster_id, item_id, term, tf)`` of ``documents`` (cluster_id, item_id, document_text)."""
    stop = list(ENGLISH if stop_words is None else stop_words)
    # A literal list of words becomes a hash set in the filter, ahead of the shuffle.
    return (
        documents.select("cluster_id", "item_id", F.explode(words(F.col("document_text"))).alias("term"))
        .filter(~F.col("term").isin(stop))
        .groupBy("cluster_id", "item_id", "term")
        .agg(F.count("*").alias("tf"))
    )


def term_scores(documents: DataFrame, stop_words: Sequence[str] | None = None) -> DataFrame:
    """Mean TF-IDF of each term over the documents of its cluster (documents without it count 0).

    idf is fitted per cluster: ``ln((1 + n) / (1 + df)) + 1``; document rows are L2-normalised.
    """
    # Counted once: the frequencies and the weights both read it.
    terms = materialize(document_terms(documents, stop_words), "terms")
    sizes = documents.groupBy("cluster_id").agg(F.count("*").alias("n"))
    frequency = terms.groupBy("cluster_id", "term").agg(F.count("*").alias("df"))
    idf = frequency.join(sizes, "cluster_id").select(
        "cluster_id", "term", "df", "n", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")
    )
    # A common word of a huge cluster is one key with a row per document.
    weighted = join_by_weight(terms, idf, ["cluster_id", "term"], "df", "item_id").withColumn("weight", F.col("tf") * F.col("idf"))
    # One document per window: bounded by the document, never by the cluster.
    document = Window.partitionBy("cluster_id", "item_id")
    unit = F.col("weight") / F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(document))
    return (
        weighted.select("cluster_id", "term", "n", unit.alias("unit"))
        .groupBy("cluster_id", "term", "n")
        .agg(F.sum("unit").alias("total"))
        .select("cluster_id", "term", F.round(F.col("total") / F.col("n"), 9).alias("score"))
    )


def keywords(documents: DataFrame, max_keywords: int = MAX_KEYWORDS, stop_words: Sequence[str] | None = None) -> DataFrame:
    """``(cluster_id, position, term, score)``: the best terms, ties in alphabetical order.

    Each partition first keeps its own best few per cluster (the optimizer pushes the rank limit
    below the shuffle), so a cluster with a huge vocabulary sends little to its final task.
    """
    limit = positive_limit(max_keywords)
    best_first = Window.partitionBy("cluster_id").orderBy(F.col("score").desc(), F.col("term").asc())
    return (
        term_scores(documents, stop_words)
        .withColumn("position", F.row_number().over(best_first))
        .filter(F.col("position") <= limit)
    )


def label_clusters(documents: DataFrame, max_keywords: int = MAX_KEYWORDS, stop_words: Sequence[str] | None = None) -> DataFrame:
    """``(cluster_id, label, keywords)``."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "term")))
    return (
        keywords(documents, max_keywords, stop_words)
        .groupBy("cluster_id")
        .agg(F.transform(ordered, lambda e: e["term"]).alias("keywords"))
        .select("cluster_id", label_text(F.col("keywords")).alias("label"), "keywords")
    )


def unlabelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Clusters that cannot be labelled, with the reason: a blank text, or only stop words."""
    blank = documents.groupBy("cluster_id").agg(F.bool_or(is_blank(F.col("document_text"))).alias("blank"))
    return (
        blank.join(labels.select("cluster_id", F.lit(True).alias("labelled")), "cluster_id", "left")
        .select(
            "cluster_id",
            F.when(F.col("blank"), "empty text").when(F.col("labelled").isNull(), "no keywords").alias("reason"),
        )
        .filter(F.col("reason").isNotNull())
    )
