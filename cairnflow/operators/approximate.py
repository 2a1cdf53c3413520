"""Approximate nearest-problem search: product quantisation with probes and exact re-ranking.

A vector is cut into parts, and each part is stored as the number of its nearest centre among at most 256: a code of
one byte per part, a thirty-second of the vector. Rows lie in the cells of ``blocks.partition``, and a query visits the
``probes`` nearest cells. There its distances to all centres, a small table per query, turn the codes into estimates, for
the rows that a product with what the codes stand for leaves; the best ``rerank`` rows by estimate are compared exactly. Only the centres and cells travel to tasks.

Codes are short, so one group holds those of ``BUNDLE`` blocks: a query goes there once for all its cells, and leaves one
list of candidates. For the exact comparison it goes once to each block of vectors that has some of them.

The centres are fitted on a bounded sample (``SAMPLE`` rows, the ones whose ids hash lowest); every row is coded. A query
whose cells hold fewer than ``limit`` rows is answered by the exact search.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.functions.vectors import normalize
from cairnflow.operators.blocks import (
    BLOCK_ROWS,
    NEIGHBOURS,
    PACKED,
    SPREAD,
    Cells,
    NearestRows,
    best_of,
    distances,
    join_blocks,
    nearest_neighbours,
    ordered,
    packing,
    partition,
    positions,
    row_slices,
    sized_blocks,
    stack,
)
from cairnflow.session import materialize, materialize_counted
from cairnflow.sources.scopes import positive_limit

SAMPLE = 16_384
CENTRES = 256
PART = 4
STEPS = 12
PROBES = 64
RERANK = 40
# Blocks whose codes one group holds: 64 x 4096 rows of 16 bytes and an id are 6 MB.
BUNDLE = 64


def fit_centres(base: DataFrame, sample: int = SAMPLE, part: int = PART, steps: int = STEPS) -> list[np.ndarray]:
    """Centres of every part of the vectors, by Lloyd's steps on at most ``sample`` rows."""
    # Bounded by ``sample`` rows.
    rows = base.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    data = stack(rows["vector"])
    found = []
    for start in range(0, data.shape[1], part):
        piece = data[:, start : start + part]
        centres = piece[:: max(1, len(piece) // CENTRES)][:CENTRES].copy()
        for _ in range(steps):
            nearest = distances(piece, centres).argmin(1)
            counts = np.bincount(nearest, minlength=len(centres))
            sums = np.stack([np.bincount(nearest, piece[:, d], len(centres)) for d in range(piece.shape[1])], 1)
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        found.append(centres)
    return found


def coded(rows: DataFrame, centres: list[np.ndarray], part: int = PART) -> DataFrame:
    """``rows`` with ``code`` in place of the vector."""

    @F.pandas_udf("binary")
    def code(vectors: pd.Series) -> pd.Series:
        data = stack(vectors)
        numbers = [distances(data[:, k * part : (k + 1) * part], c).argmin(1) for k, c in enumerate(centres)]
        return pd.Series([row.tobytes() for row in np.stack(numbers, 1).astype(np.uint8)])

    return rows.withColumn("code", code("vector")).drop("vector")


def bundles(cells: Cells) -> np.ndarray:
    """The number of the first block of each cell; blocks of one bundle are numbered in a row."""
    return np.concatenate([[0], np.cumsum(cells.blocks)])[:-1]


def bundled(rows: DataFrame, cells: Cells) -> DataFrame:
    """``rows`` of (cell, block) with their bundle in place of those; ``place`` is the cell."""
    first = F.array(*[F.lit(int(n)) for n in bundles(cells)])
    number = F.element_at(first, F.col("cell") + 1) + F.col("block")
    return rows.withColumn("place", F.col("cell")).withColumns({"cell": F.floor(number / BUNDLE).cast("int"), "block": F.lit(0)})


def probed(queries: DataFrame, cells: Cells, probes: int) -> DataFrame:
    """Each query with the bundles that hold its ``probes`` nearest filled cells, and those cells as ``places``."""
    if cells.block_count == 1:
        return queries.withColumns({"places": F.array(F.lit(0)), "cell": F.lit(0), "block": F.lit(0)})
    filled = np.where(cells.blocks > 0, 0.0, np.inf)
    pivots, wanted = cells.pivots, min(probes, int((cells.blocks > 0).sum()))
    low, high = bundles(cells) // BUNDLE, (bundles(cells) + cells.blocks - 1) // BUNDLE

    @F.pandas_udf("array<array<int>>")
    def nearest(vectors: pd.Series) -> pd.Series:
        """The number of a bundle, then its cells."""
        table = distances(stack(vectors), pivots) + filled
        found = []
        for near in np.argpartition(table, wanted - 1, axis=1)[:, :wanted].astype("int32"):
            some = {}
            for cell in near.tolist():
                for bundle in range(low[cell], high[cell] + 1):
                    some.setdefault(int(bundle), []).append(cell)
            found.append([[bundle, *inside] for bundle, inside in some.items()])
        return pd.Series(found)

    reached = queries.select("*", F.explode(nearest("vector")).alias("_visit"))
    places = F.slice("_visit", F.lit(2), F.size("_visit") - 1)
    return reached.select(*queries.columns, places.alias("places"), F.element_at("_visit", 1).alias("cell"), F.lit(0).alias("block"))


class Decoded:
    """The vectors that codes stand for, a slice at a time."""

    def __init__(self, codes: np.ndarray, centres: list[np.ndarray]) -> None:
        self.codes, self.centres = codes, centres

    def __len__(self) -> int:
        return len(self.codes)

    def __getitem__(self, some: slice) -> np.ndarray:
        return np.concatenate([c[self.codes[some, k]] for k, c in enumerate(self.centres)], 1)


def _estimates(centres: list[np.ndarray], rerank: int, part: int):
    """The ``rerank`` rows of least estimate in the cells that each query visits.

    An estimate is the squared distance to the row that a code stands for, so the block search finds the candidates.
    """

    def kernel(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"id": [], "neighbour": [], "estimate": []})
        if queries.empty or rows.empty:
            return none
        rows = rows.sort_values("place", kind="stable")
        left, ids = stack(queries["vector"]), rows["id"].to_numpy()
        codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
        whole = np.isfinite(left).all(1)
        if not whole.any() or not all(np.isfinite(c).all() for c in centres):
            return none
        left, queries = left[whole], queries[whole]
        place, start = np.unique(rows["place"].to_numpy(), return_index=True)
        stop = np.append(start[1:], len(rows))
        visited = np.stack([np.isin(place, near) for near in queries["places"]], 1)
        groups = [(0, len(rows), None)] if visited.all() else list(zip(start.tolist(), stop.tolist(), visited))

        def estimate(row: np.ndarray, column: np.ndarray) -> np.ndarray:
            if not len(row):
                return np.empty(0)
            # The tables of a tile of queries only: those of all would be as large as the vectors.
            first = int(row.min())
            asking = left[first : int(row.max()) + 1]
            tables = (distances(asking[:, k * part : (k + 1) * part], c) ** 2 for k, c in enumerate(centres))
            return sum(t[row - first, codes[column, k]] for k, t in enumerate(tables))

        near = NearestRows(left, Decoded(codes, centres), ids, min(rerank, len(rows)), estimate, groups=groups)
        asked = queries["id"].to_numpy()
        found = [(asked[row], ids[column], value) for row, column, value in near]
        return pd.DataFrame(dict(zip(none.columns, map(np.concatenate, zip(*found)))))

    return kernel


def exact_block(ids: np.ndarray, count: int) -> np.ndarray:
    """The block that holds the vector of an id for the exact comparison."""
    return ((ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(count)


LISTS = "id long, cell int, block int, candidates array<long>"


def _lists(count: int):
    """A row per query and block with the candidates of that block."""

    def by_block(ids: np.ndarray, rows: np.ndarray, neighbours: np.ndarray, _, __) -> pd.DataFrame:
        block = exact_block(neighbours, count).astype(np.int64)
        group = rows * count + block
        order = np.argsort(group, kind="stable")
        start = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
        lists = np.split(neighbours[order], start[1:])
        ids, block = ids[order[start]], block[order[start]].astype("int32")
        return pd.DataFrame({"id": ids, "cell": np.zeros(len(ids), "int32"), "block": block, "candidates": pd.Series(lists, dtype=object)})

    return by_block


def _measured(limit: int):
    """The nearest ``limit`` of each query's ``candidates``, compared exactly."""

    def kernel(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({"id": [], "neighbour": [], "distance": []})
        order = np.argsort(rows["id"].to_numpy(), kind="stable")
        others, right = rows["id"].to_numpy()[order], stack(rows["vector"])[order]
        left, asked = stack(queries["vector"]), queries["id"].to_numpy()
        found = []
        for some in row_slices(len(left), max(map(len, queries["candidates"])) * left.shape[1]):
            near = queries["candidates"].iloc[some]
            row, wanted = np.repeat(np.arange(len(near)), near.map(len)), np.concatenate(near.to_numpy())
            # An id may stand for several rows: each is an answer of its own.
            low, high = np.searchsorted(others, wanted), np.searchsorted(others, wanted, side="right")
            at = np.repeat(low, high - low) + np.arange((high - low).sum()) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
            row = np.repeat(row, high - low)
            value = np.round(np.sqrt(((left[some][row] - right[at]) ** 2).sum(1)), 12)
            # What lies beyond the last of ``limit`` is not sorted.
            counts = np.bincount(row, minlength=len(near))
            table = np.full((len(near), max(limit, counts.max())), np.inf)
            table[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = value
            close = ~(value > np.partition(table, limit - 1, axis=1)[row, limit - 1])
            row, at, value = ordered(row[close], at[close], value[close], others, limit)
            found.append((asked[some][row], others[at], value))
        return pd.DataFrame(dict(zip(("id", "neighbour", "distance"), map(np.concatenate, zip(*found)))))

    return kernel


def search_approximately(
    queries: DataFrame,
    items: DataFrame,
    limit: int,
    model: str,
    probes: int = PROBES,
    rerank: int = RERANK,
    block_rows: int = BLOCK_ROWS,
    sample: int = SAMPLE,
) -> DataFrame:
    """``(query_id, item_id, position, distance)`` like the exact search, most of the true answers among them.

    ``probes`` cells and ``rerank`` rows per answer wanted trade time for recall.
    """
    limit = positive_limit(limit)
    unit = lambda df, key, vector: df.select(F.col(key).cast("long").alias("id"), normalize(F.col(vector)).alias("vector")).filter("vector IS NOT NULL")
    asked = materialize(unit(queries, "query_id", "vector"), "queries")
    space = items.filter(F.col("is_problem") & F.col("embedding").isNotNull() & (F.col("embedding_model") == model))
    base, count = materialize_counted(unit(space, "id", "embedding"), "space")
    if not count:
        return asked.select(F.col("id").alias("query_id"), F.col("id").alias("item_id"), F.lit(1).alias("position"), F.lit(0.0).alias("distance")).limit(0)
    placed, cells = partition(base, block_rows, rows=count)
    centres = fit_centres(base, sample)
    # Rows and queries without an id have no candidates: the exact search answers those.
    codes = materialize(coded(bundled(placed.filter("id IS NOT NULL").select("id", "vector", "cell", "block"), cells), centres), "codes")
    wanted = limit * rerank
    visits = probed(asked.filter("id IS NOT NULL"), cells, probes)
    size = sized_blocks(base, block_rows)
    found = join_blocks(visits, codes, packing(_estimates(centres, wanted, PART)), PACKED, block_rows, SPREAD)
    blocks = -(-count // size)
    lists = materialize(best_of(found, wanted, _lists(blocks), LISTS), "candidates")

    @F.pandas_udf("int")
    def block_of(ids: pd.Series) -> pd.Series:
        return pd.Series(exact_block(ids.to_numpy(), blocks).astype("int32"))

    rows = base.filter("id IS NOT NULL").withColumns({"cell": F.lit(0), "block": block_of("id")})
    measured = join_blocks(lists.join(asked, "id"), rows, packing(_measured(limit)), PACKED, size, SPREAD)
    ranked = materialize(best_of(measured, limit, positions, f"{NEIGHBOURS}, position int"), "approximate")
    answered = ranked.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") >= min(limit, count))
    short = asked.join(answered.select("id"), "id", "left_anti")
    rest = nearest_neighbours(short, base, limit, block_rows=block_rows).select("id", "neighbour", "distance", "position")
    whole = ranked.join(answered.select("id"), "id", "left_semi").select("id", "neighbour", "distance", "position").unionByName(rest)
    return whole.select(F.col("id").alias("query_id"), F.col("neighbour").alias("item_id"), "position", (F.col("distance") * F.col("distance") / 2).alias("distance"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: number of queries, of their true neighbours, and the share of those that ``found`` has."""
    hit = found.select("query_id", "item_id", F.lit(1).alias("hit"))
    joined = exact.select("query_id", "item_id").join(hit, ["query_id", "item_id"], "left")
    return joined.agg(
        F.count_distinct("query_id").alias("queries"), F.count("*").alias("neighbours"), F.coalesce(F.sum("hit") / F.count("*"), F.lit(1.0)).alias("recall")
    )
