"""Exact vector search by pivot cells and bounded blocks.

Base rows are assigned to the nearest of a bounded set of pivots (a sample of the base itself). A
cell that holds more than ``block_rows`` rows is split by id hash, so no group ever exceeds a block,
whatever the data looks like. A query visits the block of its own cell first; what it finds there
bounds how far away a better answer can be, and the triangle inequality then rules out every cell
that lies further away. What remains is joined block by block: each block pair is a matrix product in
tiles that a cache holds, in short floats first; what rounding leaves open is measured exactly. A visit
gives one row per query, with at most ``k`` answers within its bound. Nothing is dropped: pruning is exact.

Distances are Euclidean. Cosine searches run on unit vectors, where both orders agree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.session import materialize

# One block pair holds two blocks of vectors in a Python worker: 2 x 4096 x 384 x 8 B = 25 MB.
BLOCK_ROWS = 4096
# Blocks of short vectors hold more rows, up to so many bytes: every query is sent to each block that may answer it, and
# every block to each share of queries, so what travels falls with the size of a block.
BLOCK_BYTES = 16 << 20
# Entries of a distance table that a worker holds at once (16 MB, and a few copies of it).
TABLE_ENTRIES = 1 << 21
# Rows and columns of a tile of scores: 512 x 2048 x 4 B = 4 MB.
TILE_ROWS, TILE_COLUMNS = 512, 2048
# Answers that are sorted together where lists of them are merged.
SORTED_ENTRIES = 1 << 17
# A block's queries are cut into so many shares, for the sake of the cores, where shares of SHARE_ROWS allow it.
SPREAD, SHARE_ROWS = 8, 1024
# The pivots travel to every task, so their number is capped: 1024 x 384 x 8 B = 3 MB.
MAX_PIVOTS = 1024
# Slack on pruning tests for rounding in squared distances; it only ever visits more cells.
SLACK = 1e-7


def stack(vectors: pd.Series) -> np.ndarray:
    return np.vstack(vectors.to_numpy()).astype(np.float64, copy=False)


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    squared = (left**2).sum(1)[:, None] + (right**2).sum(1)[None, :] - 2.0 * left @ right.T
    return np.sqrt(np.maximum(squared, 0.0))


def row_slices(left: int, right: int) -> list[slice]:
    """Slices of ``left`` rows whose table against ``right`` rows has at most ``TABLE_ENTRIES`` entries."""
    step = max(1, TABLE_ENTRIES // max(right, 1))
    return [slice(start, start + step) for start in range(0, left, step)]


def sized_blocks(base: DataFrame, block_rows: int) -> int:
    """Rows of a block of ``base``: ``block_rows``, or, where that is the default, what ``BLOCK_BYTES`` hold."""
    if block_rows != BLOCK_ROWS:
        return block_rows
    first = base.select(F.size("vector").alias("n")).head()
    return block_rows if first is None else max(block_rows, BLOCK_BYTES // (8 * max(first["n"], 1)))


@dataclass(frozen=True)
class Cells:
    """Pivots with, per cell, the number of blocks, the radius and the inner radius. All bounded."""

    pivots: np.ndarray
    blocks: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    pivot_ids: np.ndarray

    @property
    def block_count(self) -> int:
        return int(self.blocks.sum())


def assign(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``cell`` (nearest pivot) and ``reach`` (distance to it)."""

    @F.pandas_udf("cell int, reach double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        table = distances(stack(vectors), pivots)
        cell = table.argmin(1)
        return pd.DataFrame({"cell": cell.astype("int32"), "reach": table[np.arange(len(cell)), cell]})

    return df.withColumn("_place", nearest("vector")).select(*df.columns, "_place.cell", "_place.reach")


def sub_block(count: Column) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(7)), count).cast("int")


def partition(
    base: DataFrame, block_rows: int = BLOCK_ROWS, max_pivots: int = MAX_PIVOTS, rows: int | None = None
) -> tuple[DataFrame, Cells]:
    """Place ``base`` (id, vector, ...) into cells and blocks; returns the written rows and the cells."""
    rows = base.count() if rows is None else rows
    if rows <= block_rows:
        whole = Cells(np.zeros((1, 1)), np.ones(1, dtype=np.int64), np.zeros(1), np.full(1, np.inf), np.empty(0, np.int64))
        return base.withColumns({"cell": F.lit(0), "reach": F.lit(0.0), "block": F.lit(0)}), whole
    wanted = max(1, min(max_pivots, -(-rows // block_rows)))
    sample = base.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(wanted).toPandas()
    pivots = stack(sample["vector"]) if len(sample) else np.zeros((1, 1))
    placed = materialize(assign(base, pivots), "cells")
    # One row per cell, at most ``max_pivots`` of them.
    stats = (
        placed.groupBy("cell")
        .agg(F.count("*").alias("n"), F.min("reach").alias("inner"), F.max("reach").alias("outer"))
        .toPandas()
    )
    blocks = np.zeros(len(pivots), dtype=np.int64)
    inner = np.full(len(pivots), np.inf)
    outer = np.full(len(pivots), -np.inf)
    blocks[stats["cell"]] = -(-stats["n"].to_numpy() // block_rows)
    inner[stats["cell"]] = stats["inner"]
    outer[stats["cell"]] = stats["outer"]
    counts = F.array(*[F.lit(int(b)) for b in blocks])
    block = sub_block(F.element_at(counts, F.col("cell") + 1))
    return placed.withColumn("block", block), Cells(pivots, blocks, inner, outer, sample["id"].to_numpy())


def home_targets(queries: DataFrame, cells: Cells) -> DataFrame:
    """Each query with the one block it visits first, in its nearest non-empty cell."""
    if cells.block_count == 1:
        return queries.withColumns({"cell": F.lit(0), "block": F.lit(0)})
    filled = np.where(cells.blocks > 0, 0.0, np.inf)
    pivots = cells.pivots

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        return pd.Series((distances(stack(vectors), pivots) + filled).argmin(1).astype("int32"))

    counts = F.array(*[F.lit(int(b)) for b in cells.blocks])
    return queries.withColumn("cell", nearest("vector")).withColumn(
        "block", sub_block(F.element_at(counts, F.col("cell") + 1))
    )


def reachable_cells(cells: Cells) -> Callable[[Column, Column], Column]:
    """A column function: the cells that can hold a row within ``bound`` of ``vector``."""
    pivots, inner, outer = cells.pivots, cells.inner, cells.outer

    @F.pandas_udf("array<int>")
    def reachable(vectors: pd.Series, bounds: pd.Series) -> pd.Series:
        table = distances(stack(vectors), pivots)
        nearest_possible = np.maximum(np.maximum(table - outer, inner - table), 0.0)
        within = nearest_possible <= bounds.to_numpy(dtype=float)[:, None] * (1 + SLACK) + SLACK
        return pd.Series([np.flatnonzero(row).astype("int32") for row in within])

    return reachable


def with_targets(queries: DataFrame, cells: Cells, bound: str) -> DataFrame:
    """Explode queries to the blocks of every cell within their bound."""
    counts = F.array(*[F.lit(int(b)) for b in cells.blocks])
    cell = F.explode(reachable_cells(cells)("vector", F.col(bound))).alias("cell")
    return (
        queries.select("*", cell)
        .withColumn("_blocks", F.element_at(counts, F.col("cell") + 1))
        .filter(F.col("_blocks") > 0)
        .select(
            *queries.columns,
            "cell",
            F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"),
        )
    )


def join_blocks(
    visits: DataFrame,
    base: DataFrame,
    kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    block_rows: int,
    spread: int = 1,
) -> DataFrame:
    """Run ``kernel(queries, base_rows)`` on every visited block.

    ``visits`` carries (cell, block) per query. Queries of one block are cut into shares of about
    ``block_rows`` as well, and the base block is repeated once per share, so both sides of a
    group are bounded. ``spread`` asks for smaller shares of a block with few queries.
    """
    share = F.greatest(F.least(F.count("*") / spread, F.lit(float(block_rows))), F.lit(float(min(SHARE_ROWS, block_rows))))
    per_block = visits.groupBy("cell", "block").agg(F.ceil(F.count("*") / share).cast("int").alias("_shares"))
    shared = visits.join(per_block, ["cell", "block"])
    left = shared.withColumn("share", F.pmod(F.xxhash64("id", F.lit(11)), F.col("_shares")).cast("int")).drop("_shares")
    right = base.join(per_block, ["cell", "block"]).withColumn(
        "share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))
    ).drop("_shares")
    # Fresh names for the base columns: queries and base may be the same rows.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    keys = ["cell", "block", "share"]

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return kernel(queries, rows)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


NEIGHBOURS = "id long, neighbour long, distance double"
PACKED = "id long, neighbours array<long>, distances array<double>"


def k_smallest(
    table: np.ndarray, left: np.ndarray, right: np.ndarray, others: np.ndarray, k: int, floor: Callable | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other id, value) of the k smallest finite entries per row, ties by id.

    ``table`` holds distances from the matrix form, which loses digits. Whatever it places within
    rounding reach of the k-th value is measured again by direct difference (``floor`` may raise the
    measured values to mutual reachability), rounded to 12 digits, and ordered by (value, id).
    """
    k = min(k, table.shape[1])
    slack = 1e-6 * (1.0 + np.sqrt((left**2).sum(1).max()) + np.sqrt((right**2).sum(1).max()))
    kth = np.partition(table, k - 1, axis=1)[:, k - 1]
    rows, columns = np.nonzero((table <= (kth + slack)[:, None]) & np.isfinite(table))
    values = np.empty(len(rows))
    for start in range(0, len(rows), 65536):
        part = slice(start, start + 65536)
        values[part] = np.sqrt(((right[columns[part]] - left[rows[part]]) ** 2).sum(1))
    if floor is not None:
        values = floor(rows, columns, values)
    values = np.round(values, 12)
    order = np.lexsort((others[columns], values, rows))
    rows, columns, values = rows[order], columns[order], values[order]
    first = np.searchsorted(rows, rows, side="left")
    kept = np.arange(len(rows)) - first < k
    return rows[kept], others[columns[kept]], values[kept]


class Factors:
    """Factors of a product that is the larger, the nearer two rows are, with what rounding may do to it.

    For rows x of ``left`` and y of ``right``, both about the mean of ``right`` and scaled to length 1 at most, it is
    x.y - y.y / 2, so y lies within t of x where it is (x.x - t^2) / 2 or more.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, dtype: type) -> None:
        # ``right`` is read in slices, for it may be decoded only then.
        slices = [slice(start, start + BLOCK_ROWS) for start in range(0, len(right), BLOCK_ROWS)]
        centre = sum(right[some].sum(0) for some in slices) / len(right)
        self.left, own = self._of(left, [slice(start, start + BLOCK_ROWS) for start in range(0, len(left), BLOCK_ROWS)], centre, dtype)
        self.right, other = self._of(right, slices, centre, dtype)
        self.scale = float(np.sqrt(max(own.max(), other.max()))) or 1.0
        longest = np.sqrt(other.max()) / self.scale
        self.left[:, :-1] /= self.scale
        self.left[:, -1] = 1
        self.right[:, :-1] /= self.scale
        self.right[:, -1] = -other / (2 * self.scale**2)
        self.squared = own / self.scale**2
        reach = np.sqrt(self.squared) * longest + longest**2 + self.squared
        # Values are rounded to 12 digits.
        self.slack = (len(centre) + 16) * np.finfo(dtype).eps * reach + 4e-12 / self.scale

    @staticmethod
    def _of(rows: np.ndarray, slices: list[slice], centre: np.ndarray, dtype: type) -> tuple[np.ndarray, np.ndarray]:
        wide, squares = np.empty((len(rows), len(centre) + 1), dtype), np.empty(len(rows))
        for some in slices:
            part = rows[some] - centre
            wide[some, :-1] = part
            squares[some] = np.einsum("ij,ij->i", part, part)
        return wide, squares

    def cut(self, part: np.ndarray | slice, distance: np.ndarray) -> np.ndarray:
        """What the product of a row of ``left`` and any row within ``distance`` reaches."""
        within = distance / self.scale * (1 + 1e-9) + 1e-11 / self.scale
        return self._lowered((self.squared[part] - within**2) / 2 - self.slack[part])

    def below(self, part: np.ndarray | slice, score: np.ndarray) -> np.ndarray:
        """What a row reaches that may be as near as one of ``score``."""
        return self._lowered(score - 2 * self.slack[part])

    def _lowered(self, cut: np.ndarray) -> np.ndarray:
        return np.nextafter(cut.astype(self.left.dtype), self.left.dtype.type(-np.inf))


def comparable(left: np.ndarray, right: np.ndarray) -> bool:
    """Whether all entries are finite and their squares neither overflow nor vanish in short floats."""
    with np.errstate(over="ignore", invalid="ignore"):
        largest = max(np.abs(left).max(initial=0.0), np.abs(right).max(initial=0.0))
    return bool(largest == 0.0 or 1e-15 < largest < 1e15)


def ordered(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, others: np.ndarray, k: int):
    """The first k of each row by (value, other id)."""
    order = np.lexsort((others[columns], values, rows))
    rows, columns, values = rows[order], columns[order], values[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[kept], columns[kept], values[kept]


def _merged_scores(kept: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The largest of ``kept`` and ``scores`` per row, as many as ``kept`` has."""
    order = np.argsort(rows, kind="stable")
    rows, scores = rows[order], scores[order]
    counts = np.bincount(rows, minlength=len(kept))
    more = np.full((len(kept), counts.max()), -np.inf, kept.dtype)
    more[rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)] = scores
    both = np.concatenate([kept, more], 1)
    return np.partition(both, both.shape[1] - kept.shape[1], 1)[:, -kept.shape[1] :]


class NearestRows:
    """The ``k`` rows of ``right`` of least ``measure`` for each row of ``left``, ties by ``others``.

    ``measure(rows, columns)`` has to grow with the distance, and to be it where there are ``limits`` beyond which nothing is
    wanted. ``ids`` name rows that are not their own answer, and ``groups`` of (first column, last column, whether a row of ``left`` asks
    there) restrict the search. Scores in short floats choose the candidates; rows whose candidates those cannot tell
    apart are scored in long ones.
    """

    def __init__(self, left, right, others, k, measure, limits=None, ids=None, groups=None) -> None:
        self.left, self.right, self.others, self.k, self.measure, self.limits = left, right, others, k, measure, limits
        self.groups = [(0, len(right), None)] if groups is None else groups
        self.factors: dict[type, Factors] = {}
        self.same = (np.empty(0, np.int64),) * 2
        if ids is not None:
            order = np.argsort(others, kind="stable")
            low, high = np.searchsorted(others, ids, sorter=order), np.searchsorted(others, ids, side="right", sorter=order)
            row = np.repeat(np.arange(len(ids)), high - low)
            column = order[np.arange(len(row)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)]
            equal = ids[row] == others[column]
            self.same = row[equal], column[equal]

    def __iter__(self):
        """(row, column, value) of a tile of rows at a time, in order."""
        for start in range(0, len(self.left), TILE_ROWS):
            part = slice(start, min(start + TILE_ROWS, len(self.left)))
            found = self._candidates(part, np.float32)
            rows, columns = self._candidates(part, np.float64) if found is None else found
            values = self.measure(rows, columns)
            if self.limits is not None:
                within = values <= self.limits[rows]
                rows, columns, values = rows[within], columns[within], values[within]
            yield ordered(rows, columns, values, self.others, self.k)

    def _candidates(self, part: slice, dtype: type) -> tuple[np.ndarray, np.ndarray] | None:
        if dtype not in self.factors:
            self.factors[dtype] = Factors(self.left, self.right, dtype)
        factors, n, k = self.factors[dtype], part.stop - part.start, self.k
        kept = np.full((n, k), -np.inf, dtype)
        cut = np.full(n, -np.inf, dtype) if self.limits is None else factors.cut(part, self.limits[part])
        low, high = np.searchsorted(self.same[0], [part.start, part.stop])
        same_row, same_column = self.same[0][low:high] - part.start, self.same[1][low:high]
        held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, dtype))]
        fresh: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = tiles = 0

        def settle() -> bool:
            """Raise the cuts by what was found and drop what is below them; False where too much is left for ``dtype``."""
            nonlocal kept, held, fresh, waiting, tiles
            if waiting:
                kept = _merged_scores(kept, *map(np.concatenate, zip(*fresh)))
                np.maximum(cut, factors.below(part, kept.min(1)), out=cut)
            fresh, waiting, tiles = [], 0, 0
            rows, columns, scores = map(np.concatenate, zip(*held))
            near = scores >= cut[rows]
            rows, columns, scores = rows[near], columns[near], scores[near]
            if len(rows) > 4 * n * k + 4096:
                if dtype is np.float32:
                    return False
                values = self.measure(rows + part.start, columns)
                order = np.lexsort((self.others[columns], values, rows))
                order = order[np.arange(len(order)) - np.searchsorted(rows[order], rows[order]) < k]
                rows, columns, scores = rows[order], columns[order], scores[order]
            held = [(rows, columns, scores)]
            return True

        for first, last, asking in self.groups:
            inside = np.arange(n) if asking is None else np.flatnonzero(asking[part])
            if not len(inside):
                continue
            left = factors.left[part] if len(inside) == n else factors.left[part][inside]
            for start in range(first, last, TILE_COLUMNS):
                stop = min(start + TILE_COLUMNS, last)
                table = left @ factors.right[start:stop].T
                if len(same_row):
                    here = (same_column >= start) & (same_column < stop)
                    at = np.searchsorted(inside, same_row[here]).clip(max=len(inside) - 1)
                    here = np.flatnonzero(here)[inside[at] == same_row[here]]
                    table[np.searchsorted(inside, same_row[here]), same_column[here] - start] = -np.inf
                # Rows that know too little for a cut take it from the whole tile.
                new = np.isneginf(cut[inside])
                if new.any():
                    both = np.concatenate([kept[inside[new]], table[new]], 1)
                    kept[inside[new]] = np.partition(both, both.shape[1] - k, 1)[:, -k:]
                    cut[inside[new]] = factors.below(part, kept.min(1))[inside[new]]
                hit = np.flatnonzero(table >= cut[inside][:, None])
                if len(hit):
                    row, column = np.divmod(hit, stop - start)
                    score = table.ravel()[hit]
                    there = np.isfinite(score)
                    row, column, score = row[there], column[there], score[there]
                    held.append((inside[row], column + start, score))
                    later = ~new[row]
                    fresh.append((inside[row[later]], score[later]))
                    waiting += len(fresh[-1][0])
                tiles += 1
                if (waiting >= n * k or (tiles >= 8 and len(held) > 1)) and not settle():
                    return None
        if not settle():
            return None
        rows, columns, _ = held[0]
        return rows + part.start, columns


def exact_distances(left: np.ndarray, right: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Distances by direct difference, rounded to 12 digits."""

    def measure(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        values = np.empty(len(rows))
        for start in range(0, len(rows), 65536):
            part = slice(start, start + 65536)
            values[part] = np.sqrt(((right[columns[part]] - left[rows[part]]) ** 2).sum(1))
        return np.round(values, 12)

    return measure


def top_k_kernel(k: int, exclude_self: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The k nearest rows of every query, within its ``bound`` where the queries have one."""

    def kernel(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({"id": [], "neighbour": [], "distance": []})
        left, right = stack(queries["vector"]), stack(rows["vector"])
        ids, others = queries["id"].to_numpy(), rows["id"].to_numpy()
        found = []
        if comparable(left, right):
            limits = queries["bound"].to_numpy(dtype=float) if "bound" in queries else None
            near = NearestRows(left, right, others, min(k, len(right)), exact_distances(left, right), limits, ids if exclude_self else None)
            found = [(ids[row], others[column], value) for row, column, value in near]
        else:
            for part in row_slices(len(left), len(right)):
                table = distances(left[part], right)
                if exclude_self:
                    table[ids[part][:, None] == others[None, :]] = np.inf
                row, other, value = k_smallest(table, left[part], right, others, k)
                found.append((ids[part][row], other, value))
        return pd.DataFrame(dict(zip(("id", "neighbour", "distance"), map(np.concatenate, zip(*found)))))

    return kernel


def packing(kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A kernel whose (id, neighbour, value) rows, those of a query in a row, come as one row per query, as ``PACKED``."""

    def packed(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = kernel(queries, rows)
        ids, neighbours, values = (found[c].to_numpy() for c in found.columns)
        start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.empty(0, np.int64)
        lists = [np.split(c, start[1:]) if len(start) else [] for c in (neighbours, values)]
        return pd.DataFrame({"id": ids[start], "neighbours": pd.Series(lists[0], dtype=object), "distances": pd.Series(lists[1], dtype=object)})

    return packed


def best_of(packed: DataFrame, k: int, finish: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """The k least of the answers that the ``PACKED`` rows of an id have together, by (distance, neighbour).

    ``finish(ids, rows, neighbours, distances, places)`` makes rows of them; ``rows`` number the ids, which it sees whole.
    """

    def chosen(frame: pd.DataFrame):
        counts = frame["neighbours"].map(len).to_numpy()
        ids = frame["id"].to_numpy()
        first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) & ~(pd.isna(ids[1:]) & pd.isna(ids[:-1]))])
        number = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(ids)]))
        # Whole ids at a time, as many as a core's cache can sort.
        step = np.flatnonzero(np.diff(np.r_[-1, np.cumsum(counts)[np.r_[first[1:], len(ids)] - 1] // SORTED_ENTRIES]))
        for some in np.split(np.arange(len(ids)), first[step[1:]] if len(step) else []):
            rows = np.repeat(number[some], counts[some])
            neighbours, values = (np.concatenate(frame[c].iloc[some].to_numpy()) for c in ("neighbours", "distances"))
            if number[some[-1]] - number[some[0]] + 1 < len(some):
                order = np.lexsort((neighbours, values, rows))
                rows, neighbours, values = rows[order], neighbours[order], values[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows) + 1
            near = place <= k
            rows = rows[near]
            yield finish(ids[first[rows]], rows, neighbours[near], values[near], place[near].astype("int32"))

    def run(frames):
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = frame["id"].iloc[-1:]
            same = frame["id"].isna() if last.isna().all() else frame["id"] == last.iloc[0]
            if not same.all():
                yield from chosen(frame[~same])
            held = frame[same]
        if held is not None:
            yield from chosen(held)

    return packed.repartition("id").sortWithinPartitions("id").mapInPandas(run, schema)


def positions(ids: np.ndarray, _, neighbours: np.ndarray, distances: np.ndarray, places: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"id": ids, "neighbour": neighbours, "distance": distances, "position": places})


def nearest_neighbours(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
    max_distance: float | None = None,
    placed: tuple[DataFrame, Cells] | None = None,
) -> DataFrame:
    """Exact ``(id, neighbour, distance, position)`` of the k nearest base rows of every query.

    Ties go to the lower neighbour id. ``max_distance`` drops what is further away, and prunes by it.
    """
    if placed is None:
        block_rows = sized_blocks(base, block_rows)
        placed = partition(base, block_rows)
    rows, cells = placed
    rows = rows.select("id", "vector", "cell", "block")
    points = queries.select("id", "vector")
    if max_distance is not None:
        points = points.withColumn("bound", F.lit(float(max_distance)))
    kernel = packing(top_k_kernel(k, exclude_self))
    first_visits = home_targets(points, cells)
    first = join_blocks(first_visits, rows, kernel, PACKED, block_rows, SPREAD)
    if cells.block_count > 1:
        first = materialize(first, "first-visit")
        reach = first.groupBy("id").agg(
            F.when(F.sum(F.size("neighbours")) >= k, F.max(F.array_max("distances"))).otherwise(F.lit(float("inf"))).alias("bound")
        )
        bounded = first_visits.drop("bound").join(reach, "id", "left").select(
            "id",
            "vector",
            F.col("cell").alias("home_cell"),
            F.col("block").alias("home_block"),
            F.least(
                F.coalesce("bound", F.lit(float("inf"))), F.lit(float("inf") if max_distance is None else max_distance)
            ).alias("bound"),
        )
        again = with_targets(bounded, cells, "bound").filter(
            (F.col("cell") != F.col("home_cell")) | (F.col("block") != F.col("home_block"))
        )
        rest = join_blocks(again.select("id", "vector", "bound", "cell", "block"), rows, kernel, PACKED, block_rows, SPREAD)
        first = first.unionByName(rest)
    found = best_of(first, k, positions, f"{NEIGHBOURS}, position int")
    return found if max_distance is None else found.filter(F.col("distance") <= max_distance)
