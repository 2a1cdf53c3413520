"""Nearest-problem search for one query or a table of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.functions.vectors import normalize
from cairnflow.operators.blocks import BLOCK_ROWS, nearest_neighbours
from cairnflow.operators.filters import nearest, public_documents
from cairnflow.session import materialize
from cairnflow.sources.scopes import positive_limit


def search_one(items: DataFrame, vector: list[float], limit: int, model: str) -> DataFrame:
    """Public documents nearest to one encoded query, closest first."""
    return public_documents(nearest(items, vector, limit, model))


def search_many(
    queries: DataFrame, items: DataFrame, limit: int, model: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``(query_id, item_id, position, distance)``: cosine top ``limit`` for every query at once.

    ``queries`` is ``(query_id, vector)``. The items are scanned once for all queries, and only
    block pairs that can hold an answer are compared.
    """
    limit = positive_limit(limit)
    asked = materialize(
        queries.select(F.col("query_id").cast("long").alias("id"), normalize(F.col("vector")).alias("vector")).filter(
            F.col("vector").isNotNull()
        ),
        "queries",
    )
    space = items.filter(
        F.col("is_problem") & F.col("embedding").isNotNull() & (F.col("embedding_model") == model)
    )
    base = materialize(
        space.select(F.col("id").cast("long").alias("id"), normalize(F.col("embedding")).alias("vector")).filter(
            F.col("vector").isNotNull()
        ),
        "space",
    )
    near = nearest_neighbours(asked, base, limit, block_rows=block_rows)
    return near.select(
        F.col("id").alias("query_id"),
        F.col("neighbour").alias("item_id"),
        "position",
        # Unit vectors: 1 - cos = |a - b|^2 / 2.
        (F.col("distance") * F.col("distance") / 2).alias("distance"),
    )
