"""Hierarchical density clustering (HDBSCAN) of vectors, exact and distributed.

1. Copies of a vector are folded into one point with a weight.
2. Core distances come from exact nearest neighbours (``blocks``).
3. The minimum spanning tree of mutual reachability is built by Boruvka rounds over the neighbour
   lists. A point's list also says how near an unlisted point could be; a component joins along
   its cheapest listed edge only when that bound shows no unlisted edge can be cheaper. Components
   that stay undecided get an exact search beyond their lists, bounded by the best edge they know.
   Once the edges left between components fit one group, that group merges on until nothing is certain any more.
4. The condensed tree and the excess-of-mass choice come from ``hierarchy``: all bands of weights at once.
5. Points get the topmost chosen ancestor of the cluster they fell into, with a membership probability; others are noise (-1).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnflow.operators import hierarchy
from cairnflow.operators.blocks import (
    BLOCK_ROWS,
    SPREAD,
    TILE_COLUMNS,
    TILE_ROWS,
    Cells,
    Factors,
    comparable,
    distances,
    exact_distances,
    home_targets,
    join_blocks,
    k_smallest,
    nearest_neighbours,
    ordered,
    partition,
    row_slices,
    sized_blocks,
    stack,
    with_targets,
)
from cairnflow.operators.components import relabel, roots
from cairnflow.operators.ranking import global_rank
from cairnflow.operators.skew import join_by_weight
from cairnflow.session import materialize, materialize_counted

# Fixed value: parameter defaults of the public model.
MIN_CLUSTER_SIZE = 2
# Neighbours listed per point beyond those the core distance needs.
LISTED = 16
# Edges one group may hold while trees are merged and swept.
GROUP_EDGES = 500_000
INFINITE = float("inf")


def validate(min_cluster_size: int, min_samples: int | None, metric: str) -> None:
    if isinstance(min_cluster_size, bool) or not isinstance(min_cluster_size, int) or min_cluster_size < 2:
        raise ValueError("min_cluster_size must be an integer of at least 2")
    if min_samples is not None and (isinstance(min_samples, bool) or not isinstance(min_samples, int) or min_samples < 1):
        raise ValueError("min_samples must be a positive integer or None")
    if metric != "euclidean":
        raise ValueError("metric must be 'euclidean'")


def can_cluster(points: int, min_cluster_size: int, min_samples: int | None) -> bool:
    return points >= max(min_cluster_size, min_cluster_size if min_samples is None else min_samples)


# --- points, neighbours, core distances -------------------------------------------------------


def fold_copies(points: DataFrame) -> tuple[DataFrame, int]:
    """One row per distinct vector: ``(id, vector, copies)``, id being the lowest."""
    folded = points.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    return materialize_counted(folded.select("id", "vector", "copies"), "points")


def core_distances(points: DataFrame, neighbours: DataFrame, min_samples: int, listed: int) -> DataFrame:
    """``(id, copies, core, beyond)``.

    ``core`` is the distance to the ``min_samples``-th other point, copies counted. ``beyond`` is
    how near an unlisted point could be in mutual reachability (infinite when all are listed).
    """
    weights = points.select(F.col("id").alias("neighbour"), F.col("copies").alias("weight"))
    nearest_first = Window.partitionBy("id").orderBy("position")
    covered = F.sum("weight").over(nearest_first)
    reached = (
        neighbours.join(weights, "neighbour")
        .withColumn("covered", covered)
        .join(points.select("id", "copies"), "id")
        .withColumn("core", F.when(F.col("covered") + F.col("copies") - 1 >= min_samples, F.col("distance")))
    )
    per_point = reached.groupBy("id").agg(
        F.min("core").alias("core"), F.count("*").alias("listed"), F.max("distance").alias("furthest")
    )
    core = F.when(F.col("copies") > min_samples, F.lit(0.0)).otherwise(F.col("core"))
    return (
        points.select("id", "copies")
        .join(per_point, "id", "left")
        .withColumn("core", F.coalesce(core, F.lit(0.0)))
        .select(
            "id",
            "copies",
            "core",
            F.when(F.col("listed") >= listed, F.greatest("core", "furthest")).otherwise(F.lit(INFINITE)).alias("beyond"),
        )
    )


# --- minimum spanning tree --------------------------------------------------------------------


def _edge(w, x, y, a, b):
    """An undirected edge with its original ends in id order; ``a``, ``b`` are current components."""
    return [w.alias("w"), F.least(x, y).alias("x"), F.greatest(x, y).alias("y"), a.alias("a"), b.alias("b")]


def listed_edges(neighbours: DataFrame, cores: DataFrame) -> DataFrame:
    left = cores.select("id", F.col("core").alias("core_a"))
    right = cores.select(F.col("id").alias("neighbour"), F.col("core").alias("core_b"))
    x, y = F.col("id"), F.col("neighbour")
    weight = F.greatest("distance", "core_a", "core_b")
    edges = neighbours.join(left, "id").join(right, "neighbour")
    return edges.select(*_edge(weight, x, y, x, y)).distinct()


def _cheapest(edges: DataFrame) -> DataFrame:
    """``(node, w, x, y, other)``: each component's first outgoing edge in (w, x, y) order."""
    order = ("w", "x", "y")
    both = edges.select(F.col("a").alias("node"), *order, F.col("b").alias("other")).unionAll(
        edges.select(F.col("b").alias("node"), *order, F.col("a").alias("other"))
    )
    return both.groupBy("node").agg(F.min(F.struct(*order, "other")).alias("e")).select("node", "e.*")


OUTSIDE = "id long, neighbour long, w double, comp long, other long"


def _outside_kernel(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """For every query the nearest row of another component in mutual reachability, within its ``bound`` if it has one."""
    names = ["id", "neighbour", "w", "comp", "other"]
    if queries.empty or rows.empty:
        return pd.DataFrame({c: [] for c in names})
    left, right = stack(queries["vector"]), stack(rows["vector"])
    core_l, core_r = queries["core"].to_numpy(), rows["core"].to_numpy()
    comp_l, comp_r = queries["comp"].to_numpy(), rows["comp"].to_numpy()
    asked, ids = queries["id"].to_numpy(), rows["id"].to_numpy()
    limits = queries["bound"].to_numpy(dtype=float) if "bound" in queries else np.full(len(left), INFINITE)
    direct = exact_distances(left, right)

    def measure(row: np.ndarray, column: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(direct(row, column), core_l[row]), core_r[column])

    search = _nearest_outside if comparable(left, right) else _nearest_outside_by_tables
    found = [(asked[row], ids[column], value, comp_l[row], comp_r[column]) for row, column, value in search(left, right, (core_l, core_r), (comp_l, comp_r), ids, limits, measure)]
    return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*found)))))


def _nearest_outside(left, right, cores, comps, ids, limits, measure):
    """(row, column, value) of the nearest row of another component: a distance above the least value known is not measured."""
    factors = {np.float32: Factors(left, right, np.float32)}
    for start in range(0, len(left), TILE_ROWS):
        part = slice(start, min(start + TILE_ROWS, len(left)))
        comp, best = comps[0][part], limits[part].copy()
        at = np.full(len(comp), -1)
        for first in range(0, len(right), TILE_COLUMNS):
            some = slice(first, min(first + TILE_COLUMNS, len(right)))
            table = factors[np.float32].left[part] @ factors[np.float32].right[some].T
            # Any row of another component bounds the answer of a query without a bound.
            free = np.flatnonzero(np.isinf(best))
            if len(free):
                others = np.where(comp[free][:, None] == comps[1][some], -np.inf, table[free])
                column = others.argmax(1)
                free, column = free[others.max(1) > -np.inf], column[others.max(1) > -np.inf]
                best[free] = measure(free + start, column + first)
            for dtype in (np.float32, np.float64):
                if dtype not in factors:
                    factors[dtype] = Factors(left, right, dtype)
                if dtype is np.float64:
                    table = factors[dtype].left[part] @ factors[dtype].right[some].T
                near = table >= factors[dtype].cut(part, best)[:, None]
                near[np.isinf(best)] = False
                if np.count_nonzero(near) > near.size // 16:
                    near &= comp[:, None] != comps[1][some]
                row, column = np.divmod(np.flatnonzero(near), near.shape[1])
                apart = comp[row] != comps[1][some][column]
                row, column = row[apart], column[apart] + first
                if len(row) <= 8 * len(comp):
                    break
            if len(row):
                value = measure(row + start, column)
                within = value <= best[row]
                row, column, value = ordered(row[within], column[within], value[within], ids, 1)
                better = (at[row] < 0) | (value < best[row]) | (ids[column] < ids[at[row]])
                row, column, value = row[better], column[better], value[better]
                at[row], best[row] = column, value
        row = np.flatnonzero(at >= 0)
        yield row + start, at[row], best[row]


def _nearest_outside_by_tables(left, right, cores, comps, ids, limits, measure):
    """The same by tables of distances, for vectors beyond what short floats hold."""
    by_id = np.argsort(ids, kind="stable")
    places = np.argsort(by_id)
    for part in row_slices(len(left), len(right)):
        core = cores[0][part]
        table = np.maximum(np.maximum(distances(left[part], right), core[:, None]), cores[1][None, :])
        table[comps[0][part][:, None] == comps[1][None, :]] = np.inf
        floor = lambda row, column, value, core=core: np.maximum(np.maximum(value, core[row]), cores[1][column])
        row, place, value = k_smallest(table, left[part], right, places, 1, floor)
        yield row + part.start, by_id[place], value


def _pivot_edges(points: DataFrame, cells: Cells, cores: DataFrame, comps: DataFrame) -> DataFrame:
    """Real edges from points to pivots of other components: a cheap first bound per component."""
    ids = [int(i) for i in cells.pivot_ids]
    # At most one row per pivot.
    known = cores.join(comps, "id").filter(F.col("id").isin(ids)).select("id", "core", "comp").toPandas().set_index("id").loc[ids]
    pivots, pivot_core, pivot_comp = cells.pivots, known["core"].to_numpy(), known["comp"].to_numpy()

    @F.pandas_udf("neighbour long, w double, other long")
    def nearest_pivot(vectors: pd.Series, core: pd.Series, comp: pd.Series) -> pd.DataFrame:
        left = stack(vectors)
        table = np.maximum(np.maximum(distances(left, pivots), core.to_numpy()[:, None]), pivot_core[None, :])
        table[comp.to_numpy()[:, None] == pivot_comp[None, :]] = np.inf
        best = table.argmin(1)
        exact = np.sqrt(((pivots[best] - left) ** 2).sum(1))
        exact = np.round(np.maximum(np.maximum(exact, core.to_numpy()), pivot_core[best]), 12)
        exact[np.isinf(table[np.arange(len(best)), best])] = np.inf
        return pd.DataFrame({"neighbour": np.asarray(ids)[best], "w": exact, "other": pivot_comp[best]})

    found = points.select("id", "comp", nearest_pivot("vector", "core", "comp").alias("p")).select("id", "comp", "p.*")
    return found.filter(F.col("w") < INFINITE)


def _search_outside(placed: DataFrame, cells: Cells, cores: DataFrame, comps: DataFrame, edges: DataFrame, block_rows: int):
    """Exact cheapest outgoing edges of all components; returns new edges and raised ``beyond`` bounds."""
    state = cores.select("id", "core", "copies", "beyond").join(comps, "id")
    points = materialize(
        placed.select("id", "vector", "cell", "block").join(state, "id"), "outside-points"
    )
    known = _cheapest(edges).select(F.col("node").alias("comp"), F.col("w").alias("best"))
    extra: DataFrame | None = None
    if len(cells.pivot_ids):
        by_pivot = materialize(_pivot_edges(points, cells, cores, comps), "pivot-edges")
        cheapest = by_pivot.groupBy("comp").agg(F.min(F.struct("w", "id", "neighbour", "other")).alias("e"))
        extra = cheapest.select("comp", "e.*")
        known = known.unionByName(extra.select("comp", F.col("w").alias("best")))
    bounds = known.groupBy("comp").agg(F.min("best").alias("bound"))
    bounded = points.join(bounds, "comp", "left").withColumn("bound", F.coalesce("bound", F.lit(INFINITE)))
    asking = bounded.filter(F.col("beyond") < F.col("bound"))
    columns = ("id", "vector", "core", "comp", "bound")
    if cells.block_count == 1:
        visits = home_targets(asking.select(*columns), cells)
    else:
        visits = with_targets(asking.select(*columns), cells, "bound")
    candidates = join_blocks(visits, points.select("id", "vector", "core", "comp", "cell", "block"), _outside_kernel, OUTSIDE, block_rows, SPREAD)
    best = F.min(F.struct("w", "neighbour", "other")).alias("e")
    found = materialize(candidates.groupBy("id", "comp").agg(best).select("id", "comp", "e.*"), "outside-edges")
    fresh = found.unionByName(extra.select(*found.columns)) if extra is not None else found
    new_edges = fresh.select(*_edge(F.col("w"), F.col("id"), F.col("neighbour"), F.col("comp"), F.col("other")))
    # A searched point has nothing unlisted nearer than what it found, or than its bound.
    raised = bounded.join(found.select("id", F.col("w").alias("found")), "id", "left").select(
        "id",
        "copies",
        "core",
        F.when(F.col("beyond") < F.col("bound"), F.least(F.coalesce("found", F.lit(INFINITE)), F.col("bound")))
        .otherwise(F.col("beyond"))
        .alias("beyond"),
    )
    return new_edges, materialize(raised, "cores")


MERGED = "kind int, a long, b long, w double, x long, y long"
TREE, MAP = 0, 1


def _merge_kernel(limits: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """All merges that are certain: edges in order, each taken if it is the first one out of a component within its limit.

    The first edge out of a component that lies beyond its limit stops it: something unlisted may be cheaper. It may
    still be joined by others, and then stops the whole.
    """
    ids = limits["node"].tolist()
    at = {node: i for i, node in enumerate(ids)}
    bound = limits["limit"].tolist()
    boss = list(range(len(ids)))
    stuck = [False] * len(ids)

    def find(i: int) -> int:
        while boss[i] != i:
            boss[i] = boss[boss[i]]
            i = boss[i]
        return i

    taken = []
    ordered = edges.sort_values(["w", "x", "y"])
    for w, x, y, a, b in zip(*[ordered[c].tolist() for c in ("w", "x", "y", "a", "b")]):
        i, j = find(at[a]), find(at[b])
        if i == j:
            continue
        stuck[i], stuck[j] = stuck[i] or w > bound[i], stuck[j] or w > bound[j]
        if stuck[i] and stuck[j]:
            continue
        low, high = (i, j) if ids[i] < ids[j] else (j, i)
        boss[high] = low
        bound[low] = min(bound[low], bound[high])
        stuck[low] = stuck[low] or stuck[high]
        taken.append((TREE, None, None, w, x, y))
    moved = [(MAP, ids[i], ids[find(i)], None, None, None) for i in range(len(ids))]
    out = pd.DataFrame(taken + moved, columns=["kind", "a", "b", "w", "x", "y"], dtype=object)
    return out.astype({"kind": "int32", "a": "Int64", "b": "Int64", "w": "float64", "x": "Int64", "y": "Int64"})


def _merged(limits: DataFrame, edges: DataFrame) -> DataFrame:
    def run(of_limits: pd.DataFrame, of_edges: pd.DataFrame) -> pd.DataFrame:
        return _merge_kernel(of_limits, of_edges)

    zero = F.lit(0).alias("all")
    left, right = limits.select(zero, "node", "limit"), edges.select(zero, "w", "x", "y", "a", "b")
    return materialize(left.groupBy("all").cogroup(right.groupBy("all")).applyInPandas(run, MERGED), "merged")


def spanning_tree(
    points: DataFrame, count: int, neighbours: DataFrame, cores: DataFrame, placed, block_rows: int, group_edges: int = GROUP_EDGES
) -> DataFrame:
    """``(x, y, w)``: the ``count - 1`` edges of a minimum spanning tree of mutual reachability."""
    rows, cells = placed
    edges, size = materialize_counted(listed_edges(neighbours, cores), "edges")
    cores = materialize(cores, "cores")
    comps = cores.select("id", F.col("id").alias("comp"))
    limits = cores.select(F.col("id").alias("node"), F.col("beyond").alias("limit"))
    tree: DataFrame | None = None
    left = count
    while left > 1:
        if left + size <= group_edges:
            merged = _merged(limits, edges)
            chosen = merged.filter(F.col("kind") == TREE).select("x", "y", "w")
            joined = chosen.count()
            if joined:
                tree = chosen if tree is None else tree.unionByName(chosen)
                left -= joined
                if left == 1:
                    break
                root = merged.filter(F.col("kind") == MAP).select(F.col("a").alias("node"), F.col("b").alias("root"))
                comps = comps.join(root.select(F.col("node").alias("comp"), "root"), "comp").select("id", F.col("root").alias("comp"))
                limits = limits.join(root, "node").groupBy(F.col("root").alias("node")).agg(F.min("limit").alias("limit"))
                edges = _lightest(relabel(edges, root).filter(F.col("a") != F.col("b")))
            # Nothing else is certain from the lists: look beyond them.
            comps, edges = materialize(comps, "comps"), materialize(edges, "edges")
            added, cores = _search_outside(rows, cells, cores, comps, edges, block_rows)
            edges, size = materialize_counted(_lightest(edges.unionByName(added)), "edges")
            limits = comps.join(cores, "id").groupBy(F.col("comp").alias("node")).agg(F.min("beyond").alias("limit"))
            continue
        known = limits.join(_cheapest(edges), "node", "left")
        sure = known.filter(F.col("w") <= F.col("limit")).select("node", F.col("other").alias("to"))
        # Two components may pick the same edge; the lower one of such a pair is the root.
        back = sure.select(F.col("node").alias("other"), F.col("to").alias("back"))
        mutual = (F.col("back") == F.col("node")) & (F.col("node") < F.col("other"))
        parent = F.when(F.col("w") <= F.col("limit"), F.when(F.coalesce(mutual, F.lit(False)), F.col("node")).otherwise(F.col("other")))
        picks, joined = materialize_counted(
            known.join(back, "other", "left").select("node", "limit", "w", "x", "y", parent.alias("parent")),
            "picks",
            F.count_if(F.col("parent") != F.col("node")),
        )
        if not joined:
            comps = materialize(comps, "comps")
            added, cores = _search_outside(rows, cells, cores, comps, edges, block_rows)
            edges, size = materialize_counted(_lightest(edges.unionByName(added)), "edges")
            limits = comps.join(cores, "id").groupBy(F.col("comp").alias("node")).agg(F.min("beyond").alias("limit"))
            continue
        # Every pick that leads to another component is one tree edge.
        chosen = picks.filter(F.col("parent") != F.col("node")).select("x", "y", "w")
        tree = chosen if tree is None else tree.unionByName(chosen)
        left -= joined
        if left > 1:
            root = roots(picks.filter(F.col("parent").isNotNull()).select("node", "parent"))
            merged = root.select(F.col("node").alias("comp"), "root")
            comps = comps.join(merged, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"))
            limits = (
                picks.select("node", "limit")
                .join(root, "node", "left")
                .groupBy(F.coalesce("root", "node").alias("node"))
                .agg(F.min("limit").alias("limit"))
            )
            edges, size = materialize_counted(_lightest(relabel(edges, root).filter(F.col("a") != F.col("b"))), "edges")
    return tree


def _lightest(edges: DataFrame) -> DataFrame:
    """One edge per pair of components: the first in (w, x, y) order."""
    return (
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w", "x", "y")
        .groupBy("a", "b")
        .agg(F.min(F.struct("w", "x", "y")).alias("e"))
        .select("e.*", "a", "b")
    )


# --- the operator -----------------------------------------------------------------------------


def density_clusters(
    points: DataFrame,
    min_cluster_size: int = MIN_CLUSTER_SIZE,
    min_samples: int | None = None,
    metric: str = "euclidean",
    listed: int = LISTED,
    block_rows: int = BLOCK_ROWS,
    group_edges: int = GROUP_EDGES,
) -> DataFrame:
    """``(id, cluster_id)`` for ``points`` (id, vector); noise is -1.

    Clusters are numbered from 0 by their lowest point id.
    """
    return memberships(points, min_cluster_size, min_samples, metric, listed, block_rows, group_edges).select("id", "cluster_id")


def memberships(
    points: DataFrame,
    min_cluster_size: int = MIN_CLUSTER_SIZE,
    min_samples: int | None = None,
    metric: str = "euclidean",
    listed: int = LISTED,
    block_rows: int = BLOCK_ROWS,
    group_edges: int = GROUP_EDGES,
) -> DataFrame:
    """``(id, cluster_id, probability)``: how firmly a point belongs to its cluster, from the density at which it joined.

    The densest points of a cluster have 1, a point that joined at half that density 0.5; noise has 0.
    """
    validate(min_cluster_size, min_samples, metric)
    points, total = materialize_counted(
        points.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")), "input"
    )
    noise = points.select("id", F.lit(-1).alias("cluster_id"), F.lit(0.0).alias("probability"))
    if not can_cluster(total, min_cluster_size, min_samples):
        return noise
    samples = max(1, min(total - 1, min_cluster_size if min_samples is None else min_samples))
    distinct, count = fold_copies(points)
    if count == 1:
        # One vector only: a single root, which is never a cluster.
        return noise
    listed = max(listed, samples)
    block_rows = sized_blocks(distinct, block_rows)
    placed = partition(distinct, block_rows, rows=count)
    neighbours = materialize(
        nearest_neighbours(distinct, distinct, listed, exclude_self=True, block_rows=block_rows, placed=placed), "neighbours"
    )
    cores = materialize(core_distances(distinct, neighbours, samples, listed), "cores")
    tree = spanning_tree(distinct, count, neighbours, cores, placed, block_rows, group_edges)
    assigned = materialize(hierarchy.flat_clusters(tree, cores, min_cluster_size, group_edges), "assigned")
    lowest = assigned.groupBy("chosen").agg(F.min("id").alias("lowest"))
    numbers = global_rank(lowest, [F.col("lowest").asc()], name="number")
    labelled = assigned.join(numbers, "chosen").select(F.col("id").alias("first"), (F.col("number") - 1).alias("label"), "probability")
    # Every copy gets the label of its folded point; a vector may have very many copies.
    # Sorted by a hash first: whole vectors are compared only where two of those are equal.
    digest = F.xxhash64("vector").alias("digest")
    folded = distinct.select(digest, "vector", F.col("id").alias("first"), "copies")
    originals = join_by_weight(points.select("id", digest, "vector"), folded, ["digest", "vector"], "copies", "id")
    return originals.join(labelled, "first", "left").select(
        "id", F.coalesce("label", F.lit(-1)).cast("int").alias("cluster_id"), F.coalesce("probability", F.lit(0.0)).alias("probability")
    )


def cluster_items(items: DataFrame, model: str, **parameters) -> DataFrame:
    """``(cluster_id, item_id)`` of the embedded problems of one model, noise left out."""
    space = items.filter(
        F.col("is_problem") & F.col("embedding").isNotNull() & (F.col("embedding_model") == model)
    )
    labels = density_clusters(space.select("id", F.col("embedding").alias("vector")), **parameters)
    return labels.filter(F.col("cluster_id") != -1).select("cluster_id", F.col("id").alias("item_id"))
