"""One-to-one matching of the clusters of two runs by centroid similarity.

The result equals the greedy choice over all pairs at or above the threshold, most similar first,
ties by current id, then previous id. It is reached without listing all pairs: every cluster keeps
its best ``candidates`` partners, and the lists form a graph whose connected parts are independent. One
job passes through the pairs of each part in order. A pair is taken when both sides are free and neither
list was cut off before it; where one was, both sides stay open, since something unlisted may come first.
Open clusters get new, longer lists over what is still unmatched. The first pair of all is always certain.

A part beyond ``group_rows`` rows is worked on by rounds instead: in each, all pairs that are both
sides' best are taken at once, which are pairs that the greedy pass would take.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnflow.functions.checks import number_within
from cairnflow.functions.vectors import as_double, dot, is_valid_vector, normalize
from cairnflow.operators.blocks import (
    BLOCK_ROWS,
    distances,
    home_targets,
    join_blocks,
    k_smallest,
    partition,
    stack,
    with_targets,
)
from cairnflow.operators.components import components
from cairnflow.operators.ranking import global_rank
from cairnflow.operators.skew import join_by_weight
from cairnflow.schemas import SIMILARITY_THRESHOLD
from cairnflow.session import materialize, materialize_counted

CANDIDATES = 32
# Listed pairs one group may hold.
GROUP_ROWS = 500_000
# Rounds on a part that is larger than that, between two listings.
ROUNDS = 8


def validate_threshold(threshold: float) -> float:
    return number_within(threshold, "similarity_threshold", -1, 1)


def unit_centroids(clusters: DataFrame) -> DataFrame:
    """``(cluster_id, centroid)`` to ``(id, vector)`` with unit vectors; bad centroids fail the job."""
    vector = normalize(F.col("centroid"))
    usable = is_valid_vector(as_double(F.col("centroid")), F.size("centroid")) & vector.isNotNull()
    return clusters.select(
        F.col("cluster_id").cast("long").alias("id"),
        F.when(usable, vector)
        .otherwise(F.raise_error(F.lit("centroid must be finite and not the zero vector")))
        .alias("vector"),
    )


def _reach(threshold: float) -> float:
    # Unit vectors: |a - b|^2 = 2 - 2 cos. A little extra, the exact test follows.
    return math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + 1e-9


PAIRS = "current long, previous long, distance double, similarity double, best_of_current boolean, best_of_previous boolean"


def _pairs_kernel(threshold: float, k: int):
    reach = _reach(threshold)

    def kernel(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({c: [] for c in ("current", "previous", "distance", "similarity", "best_of_current", "best_of_previous")})
        left, right = stack(queries["vector"]), stack(rows["vector"])
        ids, others = queries["id"].to_numpy(), rows["id"].to_numpy()
        table = distances(left, right)
        table[table > reach] = np.inf
        parts = []
        for of_current in (True, False):
            if of_current:
                row, other, value = k_smallest(table, left, right, others, k)
                current, previous = ids[row], other
            else:
                row, other, value = k_smallest(table.T, right, left, ids, k)
                current, previous = other, others[row]
            parts.append(pd.DataFrame({"current": current, "previous": previous, "distance": value, "of_current": of_current}))
        both = pd.concat(parts, ignore_index=True)
        sides = both.groupby(["current", "previous"], as_index=False).agg(
            distance=("distance", "first"), best_of_current=("of_current", "max"), best_of_previous=("of_current", "min")
        )
        sides["best_of_previous"] = ~sides["best_of_previous"].astype(bool)
        sides["best_of_current"] = sides["best_of_current"].astype(bool)
        at, to = pd.Index(ids).get_indexer(sides["current"]), pd.Index(others).get_indexer(sides["previous"])
        sides["similarity"] = np.round((left[at] * right[to]).sum(1), 12)
        return sides[["current", "previous", "distance", "similarity", "best_of_current", "best_of_previous"]]

    return kernel


def _lists(current: DataFrame, previous: DataFrame, rows: int, threshold: float, k: int, block_rows: int):
    """Each side's k nearest partners (``side`` 0 or 1, ``position``, ``usable``), and the number of pairs looked at.

    One pass over the block pairs within reach of the threshold yields both sides' candidates.
    """
    placed, cells = partition(previous, block_rows, rows=rows)
    bounded = current.withColumn("bound", F.lit(_reach(threshold)))
    if cells.block_count == 1:
        visits = home_targets(current, cells)
    else:
        visits = with_targets(bounded, cells, "bound").drop("bound")
    pairs, emitted = materialize_counted(
        join_blocks(visits, placed.select("id", "vector", "cell", "block"), _pairs_kernel(threshold, k), PAIRS, block_rows),
        "pairs",
    )

    def shortest(side: str) -> DataFrame:
        order = Window.partitionBy(side).orderBy("distance", "current", "previous")
        return (
            pairs.filter(F.col(f"best_of_{side}"))
            .withColumn("position", F.row_number().over(order))
            .filter(F.col("position") <= k)
            .select("current", "previous", "distance", "similarity", "position")
        )

    usable = F.col("similarity") >= threshold
    rows = [shortest(side).withColumn("side", F.lit(at)) for at, side in enumerate(("current", "previous"))]
    return rows[0].unionByName(rows[1]).withColumn("usable", usable), emitted


def _best(pairs: DataFrame, side: str) -> DataFrame:
    order = F.struct("distance", "current", "previous", "similarity")
    return pairs.groupBy(side).agg(F.min(order).alias("best")).select("best.*")


def _without(pairs: DataFrame, taken: DataFrame) -> DataFrame:
    return pairs.join(taken.select("current"), "current", "left_anti").join(
        taken.select("previous"), "previous", "left_anti"
    )


PASSED = "current long, previous long, similarity double, still_open long"


def _greedy_kernel(k: int):
    """One pass in order; ``still_open`` counts the clusters that may have an unlisted partner."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        last = rows[rows["position"] == k]
        edge = lambda frame: list(zip(frame["distance"], frame["current"], frame["previous"]))
        limits = [{}, {}]
        for side, key in zip(last["side"], edge(last)):
            limits[side][key[1 + side]] = key
        pairs = rows[rows["usable"]].drop_duplicates(["current", "previous"])
        pairs = pairs.sort_values(["distance", "current", "previous"])
        taken: list[set] = [set(), set()]
        unsure: list[set] = [set(), set()]
        out = []
        for key, similarity in zip(edge(pairs), pairs["similarity"]):
            _, current, previous = key
            if current in taken[0] or previous in taken[1]:
                continue
            if current in unsure[0] or previous in unsure[1] or key > limits[0].get(current, key) or key > limits[1].get(previous, key):
                unsure[0].add(current)
                unsure[1].add(previous)
                continue
            taken[0].add(current)
            taken[1].add(previous)
            out.append((current, previous, similarity, None))
        left = sum(len((unsure[side] | set(limits[side])) - taken[side]) for side in (0, 1))
        out.append((None, None, None, left))
        found = pd.DataFrame(out, columns=["current", "previous", "similarity", "still_open"], dtype=object)
        return found.astype({"current": "Int64", "previous": "Int64", "similarity": "float64", "still_open": "Int64"})

    return kernel


def _pass(rows: DataFrame, k: int) -> tuple[DataFrame, int, int]:
    """Certain pairs of every part, their number, and how many clusters stay open."""
    kernel = _greedy_kernel(k)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return kernel(part)

    passed = materialize(rows.groupBy("part").applyInPandas(run, PASSED), "passed")
    totals = passed.agg(F.count("current").alias("found"), F.sum("still_open").alias("open")).head()
    pairs = passed.filter("current IS NOT NULL").select("current", "previous", "similarity")
    return pairs, totals["found"], totals["open"] or 0


def _parts(rows: DataFrame, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """Listed pairs with the connected part they are in: those of parts that fit a group, and the others."""
    ends = rows.select(F.concat(F.lit("c"), "current").alias("a"), F.concat(F.lit("p"), "previous").alias("b"))
    root = components(ends).select(F.col("node").alias("_node"), F.col("root").alias("part"))
    named = rows.withColumn("_node", F.concat(F.lit("c"), "current")).join(root, "_node").drop("_node")
    named = materialize(named.select("part", *rows.columns), "parts")
    large = named.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") > group_rows).select("part")
    return named.join(large, "part", "left_anti"), named.join(large, "part", "left_semi")


def _rounds(rows: DataFrame) -> tuple[DataFrame, int]:
    """Pairs that are each other's best, round by round."""
    sides = [rows.filter((F.col("side") == side) & F.col("usable")).select("current", "previous", "distance", "similarity") for side in (0, 1)]
    matched: DataFrame | None = None
    total = 0
    for _ in range(ROUNDS):
        both = _best(sides[0], "current").join(_best(sides[1], "previous").select("current", "previous"), ["current", "previous"])
        taken, found = materialize_counted(both.select("current", "previous", "similarity"), "matched")
        matched, total = taken if matched is None else matched.unionByName(taken), total + found
        if not found:
            break
        sides = [materialize(_without(side, taken), "unmatched-pairs") for side in sides]
    return matched, total


def match_pairs(
    current: DataFrame,
    previous: DataFrame,
    threshold: float = SIMILARITY_THRESHOLD,
    candidates: int = CANDIDATES,
    block_rows: int = BLOCK_ROWS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Matched ``(current, previous, similarity)`` of two ``(cluster_id, centroid)`` tables."""
    threshold = validate_threshold(threshold)
    current, others = materialize_counted(unit_centroids(current), "current")
    previous, rows = materialize_counted(unit_centroids(previous), "previous")
    matched: DataFrame | None = None
    left = min(others, rows)
    folded = False
    while True:
        listed, emitted = _lists(current, previous, rows, threshold, candidates, block_rows)
        if emitted <= group_rows:
            taken, found, still_open = _pass(listed.withColumn("part", F.lit(0)), candidates)
        else:
            small, large = _parts(listed, group_rows)
            taken, found, still_open = _pass(small, candidates)
            if not large.isEmpty():
                extra, more = _rounds(large)
                taken, found, still_open = taken.unionByName(extra), found + more, still_open + 1
        matched = taken if matched is None else matched.unionByName(taken)
        left -= found
        # Without an open cluster the lists were all there is; without a pair nothing is left to take.
        if not (left and found and still_open):
            return matched
        matched = materialize(matched, "matched")
        current, previous, rows = _unmatched(current, previous, matched)
        if not folded:
            # Short lists full of copies of one vector would be renewed again and again.
            folded = True
            extra = _match_copies(current, previous, threshold, candidates, block_rows)
            if extra is not None:
                matched = matched.unionByName(extra)
                current, previous, rows = _unmatched(current, previous, extra)
        candidates *= 2


def _unmatched(current: DataFrame, previous: DataFrame, matched: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    rest = materialize(current.join(matched.select(F.col("current").alias("id")), "id", "left_anti"), "current")
    other, rows = materialize_counted(
        previous.join(matched.select(F.col("previous").alias("id")), "id", "left_anti"), "previous"
    )
    return rest, other, rows


def _strict_best(pairs: DataFrame, side: str, k: int) -> DataFrame:
    """Pairs that are their side's only one at its smallest distance, so no tie rule applies.

    The last place of a full list may tie with what was cut off, and does not count.
    """
    nearest = F.min("distance").over(Window.partitionBy(side))
    return (
        pairs.withColumn("nearest", nearest)
        .filter(F.col("distance") == F.col("nearest"))
        .groupBy(side)
        .agg(F.count("*").alias("ties"), F.min(F.struct("current", "previous", "similarity", "position")).alias("e"))
        .filter((F.col("ties") == 1) & (F.col("e.position") < k))
        .select("e.current", "e.previous", "e.similarity")
    )


def _match_copies(current: DataFrame, previous: DataFrame, threshold: float, k: int, block_rows: int) -> DataFrame | None:
    """Match whole groups of identical vectors at once.

    When two groups are strictly each other's nearest, the greedy pass pairs their members in id
    order until the smaller group is used up. Groups that tie with others are left to the caller.
    Members are numbered inside their group, so a step is a segment (group, group, offsets, length).
    """

    def fold(side: DataFrame, name: str) -> tuple[DataFrame, DataFrame, int]:
        groups, n = materialize_counted(
            side.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "vector", "n"), name
        )
        own = groups.select("vector", F.col("id").alias("group"), "n")
        members = join_by_weight(side, own, ["vector"], "n", "id").select("id", "group")
        return groups, global_rank(members, [F.col("id").asc()], by=["group"], name="nth"), n

    current_groups, current_members, _ = fold(current, "current-groups")
    previous_groups, previous_members, rows = fold(previous, "previous-groups")
    listed, _ = _lists(current_groups.select("id", "vector"), previous_groups.select("id", "vector"), rows, threshold, k, block_rows)
    by_current, by_previous = [listed.filter((F.col("side") == side) & F.col("usable")).drop("side", "usable") for side in (0, 1)]
    counts = {
        "current": current_groups.select(F.col("id").alias("current"), F.col("n").alias("current_left"), F.lit(0).cast("long").alias("current_used")),
        "previous": previous_groups.select(F.col("id").alias("previous"), F.col("n").alias("previous_left"), F.lit(0).cast("long").alias("previous_used")),
    }
    segments: DataFrame | None = None
    while True:
        picks = _strict_best(by_current, "current", k).join(
            _strict_best(by_previous, "previous", k).select("current", "previous"), ["current", "previous"]
        )
        sized = picks.join(counts["current"], "current").join(counts["previous"], "previous")
        step, found = materialize_counted(
            sized.withColumn("length", F.least("current_left", "previous_left")), "segments"
        )
        if not found:
            break
        segments = step if segments is None else segments.unionByName(step)
        for side in ("current", "previous"):
            left, used = f"{side}_left", f"{side}_used"
            done = step.select(side, "length")
            after = counts[side].join(done, side, "left").withColumn("length", F.coalesce("length", F.lit(0)))
            counts[side] = materialize(
                after.select(side, (F.col(left) - F.col("length")).alias(left), (F.col(used) + F.col("length")).alias(used)),
                "group-counts",
            )
            gone = counts[side].filter(F.col(left) == 0).select(side)
            by_current, by_previous = by_current.join(gone, side, "left_anti"), by_previous.join(gone, side, "left_anti")
        by_current, by_previous = materialize(by_current, "by-current"), materialize(by_previous, "by-previous")
    if segments is None:
        return None

    def expand(side: str, members: DataFrame) -> DataFrame:
        own = members.select(F.col("group").alias(side), F.col("id").alias(f"{side}_id"), "nth")
        inside = (F.col("nth") > F.col(f"{side}_used")) & (F.col("nth") <= F.col(f"{side}_used") + F.col("length"))
        return segments.join(own, side).filter(inside).select(
            "current", "previous", "similarity", (F.col("nth") - F.col(f"{side}_used")).alias("place"), f"{side}_id"
        )

    left = expand("current", current_members)
    right = expand("previous", previous_members).drop("similarity")
    pairs = left.join(right, ["current", "previous", "place"]).select(
        F.col("current_id").alias("current"), F.col("previous_id").alias("previous"), "similarity"
    )
    return materialize(pairs, "matched-copies")


def match_clusters(
    current: DataFrame,
    previous: DataFrame,
    threshold: float = SIMILARITY_THRESHOLD,
    candidates: int = CANDIDATES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every current cluster with its match: ``matched`` or, with similarity 0, ``new``."""
    pairs = match_pairs(current, previous, threshold, candidates, block_rows)
    matched = pairs.select(
        F.col("current").alias("current_cluster_id"), F.col("previous").alias("previous_cluster_id"), "similarity"
    )
    every = current.select(F.col("cluster_id").cast("long").alias("current_cluster_id"))
    found = F.col("previous_cluster_id").isNotNull()
    return every.join(matched, "current_cluster_id", "left").select(
        "current_cluster_id",
        "previous_cluster_id",
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        F.when(found, "matched").otherwise("new").alias("status"),
    )
