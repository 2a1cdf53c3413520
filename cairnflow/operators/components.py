"""Connected components and root finding by pointer jumping.

``by`` names columns that tell separate graphs apart: node names count within their graph only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.session import materialize_counted


def roots(parents: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(node, parent)`` without cycles (roots point at themselves or are absent) to ``(node, root)``.

    Every write doubles how far up a node looks, so a chain of length n needs about log2(n) writes.
    """
    current = parents
    while True:
        upper = current.select(*by, F.col("node").alias("parent"), F.col("parent").alias("next"))
        stepped = current.join(upper, [*by, "parent"], "left").select(
            *by, "node", F.coalesce("next", "parent").alias("root"), (F.col("next") != F.col("parent")).alias("moved")
        )
        written, moved = materialize_counted(stepped, "roots", F.count_if("moved"))
        if not moved:
            return written.select(*by, "node", "root")
        current = written.select(*by, "node", F.col("root").alias("parent"))


def components(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges`` (a, b); the root is the lowest node.

    Each round every node hooks to its smallest neighbour, chains are resolved by pointer jumping,
    and the edges are contracted; the number of nodes at least halves per round.
    """
    labels: DataFrame | None = None
    while True:
        both_ways = edges.select(*by, F.col("a").alias("node"), F.col("b").alias("other")).unionAll(
            edges.select(*by, F.col("b").alias("node"), F.col("a").alias("other"))
        )
        hooks = both_ways.groupBy(*by, "node").agg(F.least("node", F.min("other")).alias("parent"))
        root = roots(hooks, by)
        if labels is None:
            labels = root
        else:
            # A round is one more join against written roots; there are about log(n) rounds.
            upper = root.select(*by, F.col("node").alias("root"), F.col("root").alias("top"))
            labels = labels.join(upper, [*by, "root"], "left").select(*by, "node", F.coalesce("top", "root").alias("root"))
        links = relabel(edges, root, by).filter(F.col("a") != F.col("b")).select(*by, "a", "b").distinct()
        edges, left = materialize_counted(links, "contracted")
        if not left:
            return labels


def relabel(edges: DataFrame, root: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Replace both ends of ``edges`` by their roots; nodes without one keep their name."""
    for end in ("a", "b"):
        mapping = root.select(*by, F.col("node").alias(end), F.col("root").alias("_to"))
        edges = edges.join(mapping, [*by, end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return edges
