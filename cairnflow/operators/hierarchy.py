"""The condensed tree of a spanning tree and its clusters of largest excess of mass, at any tree size.

The tree's edges are cut by weight into bands of about ``group_edges`` edges. All bands are swept at once, each as
one bounded group, although a band builds on those below it:

1. *Contraction.* What a node is in a band is the component it belongs to once all lighter edges are merged, named by
   its lowest point. These names come from halving: components of the lower half of the bands rename the ends in the
   upper half, then both halves are halved in the same way at once. So there are about log2(bands) steps, and the sizes
   of the contracted nodes come with them.
2. *Sweep.* A contracted node of at least ``min_cluster_size`` points holds exactly one cluster, whichever it is. Its
   band can therefore be swept under a stand-in name; it tells which points join which cluster at which density, what
   each cluster gains, which ones end, and which one each part holds in the end.
3. *Naming.* That last fact links a stand-in to the band before; pointer jumping replaces all of them by real names.
4. *Choice.* Excess of mass is decided from the leaves of the cluster tree up. A tree beyond one group is first reduced by
   rounds that remove all leaves and all chains; a removed chain keeps, for each of its clusters, a function of the
   one cluster at its lower end, which is filled in afterwards.

Every step is a bounded number of jobs per halving of something, none is a loop over bands, levels or clusters.
Edges of equal weight merge together and share a band; where such a band is too large, it is split into its connected parts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnflow.operators.components import components, relabel
from cairnflow.session import materialize, materialize_counted

# Distance 0 would be infinite density.
MAX_DENSITY = 1e12
NEVER = float("-inf")

SWEPT = "kind int, band int, node long, target long, ref_band int, ref long, density double, size long, mass double, parent long"
JOINED, LOOSE, GAINED, ENDED, HELD = range(5)


# --- bands and contraction ------------------------------------------------------------------------


def banded(events: DataFrame, count: int, group_edges: int) -> tuple[DataFrame, int]:
    """``events`` with a ``band`` by weight, and the number of bands; equal weights share one."""
    wanted = -(-count // group_edges)
    if wanted <= 1:
        return events.withColumn("band", F.lit(0)), 1
    shares = [k / wanted for k in range(1, wanted)]
    cuts = sorted(set(events.agg(F.percentile_approx("w", shares, max(10_000, 20 * wanted))).head()[0]))
    below = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda cut: cut < F.col("w")))
    return events.withColumn("band", below.cast("int")), len(cuts) + 1


def _ends(events: DataFrame) -> DataFrame:
    return events.select("lo", F.explode(F.array("a", "b")).alias("node")).distinct()


def contracted(events: DataFrame, nodes: DataFrame, bands: int) -> tuple[DataFrame, DataFrame]:
    """Ends of every event as they are called in its band, and ``(band, node, size)`` of all of them."""
    events = events.withColumn("lo", F.lit(0))
    nodes = nodes.withColumn("lo", F.lit(0))
    width = 1 << (bands - 1).bit_length()
    while width > 1:
        width //= 2
        upper = F.col("band") >= F.col("lo") + width
        low, high = events.filter(~upper), events.filter(upper)
        part = components(low.filter(F.col("a") != F.col("b")).select("lo", "a", "b"), by=["lo"])
        to = part.select("lo", "node", "root")
        held = nodes.join(to, ["lo", "node"], "left").select("lo", F.coalesce("root", "node").alias("node"), "size")
        added = low.filter("adds > 0").select("lo", F.col("a").alias("node"), F.col("adds").alias("size")).join(to, ["lo", "node"], "left")
        grown = held.unionByName(added.select("lo", F.coalesce("root", "node").alias("node"), "size")).groupBy("lo", "node").agg(F.sum("size").alias("size"))
        risen = relabel(high, to, by=["lo"]).withColumn("lo", F.col("lo") + width)
        grown = grown.withColumn("lo", F.col("lo") + width).join(_ends(risen), ["lo", "node"], "left_semi")
        kept = nodes.join(_ends(low), ["lo", "node"], "left_semi")
        nodes = materialize(kept.select("lo", "node", "size").unionByName(grown.select("lo", "node", "size")), "band-nodes")
        events = materialize(low.unionByName(risen.select(*low.columns)), "band-events")
    return events.drop("lo"), nodes.select(F.col("lo").alias("band"), "node", "size")


# --- sweep of one band ----------------------------------------------------------------------------


class _Part:
    """A connected part while its band is swept: its size, loose nodes and held clusters."""

    __slots__ = ("size", "loose", "held", "name")

    def __init__(self, node: int, size: int, held: list, name: int) -> None:
        self.size, self.name = size, name
        self.loose = [] if held else [node]
        # (cluster, points); a cluster is (band, node) under a stand-in name, else (None, event).
        self.held = held

    def absorb(self, other: _Part) -> None:
        self.size += other.size
        self.loose.extend(other.loose)
        self.held.extend(other.held)
        self.name = min(self.name, other.name)


def _sweep(min_cluster_size: int):
    """Merge the nodes of one band in order of weight.

    Nodes of parts below ``min_cluster_size`` are loose; they join a cluster when their part becomes one or meets
    one. When several clusters meet at one weight they end and a parent begins. A cluster gains the density at which
    its points joined, so its stability is that sum less its points times the density at its end.
    """

    def kernel(nodes: pd.DataFrame, events: pd.DataFrame) -> pd.DataFrame:
        band = int(nodes["band"].iloc[0])
        ids, sizes = nodes["node"].tolist(), nodes["size"].tolist()
        at = {node: i for i, node in enumerate(ids)}
        boss = list(range(len(ids)))
        parts = [_Part(i, size, [((band, node), size)] if size >= min_cluster_size else [], node) for i, (node, size) in enumerate(zip(ids, sizes))]
        joined: dict[int, tuple] = {}
        gained: dict[tuple, float] = {}
        born: dict[tuple, float] = {}
        ended = []

        def find(i: int) -> int:
            while boss[i] != i:
                boss[i] = boss[boss[i]]
                i = boss[i]
            return i

        def settle(part: _Part, name: int, density: float) -> None:
            if part.size < min_cluster_size:
                return
            if len(part.held) == 1:
                cluster, points = part.held[0]
                gained[cluster] = gained.get(cluster, 0.0) + (part.size - points) * density
            else:
                ended.extend((cluster, name, density, points) for cluster, points in part.held)
                cluster = (None, name)
                gained[cluster] = part.size * density
                born[cluster] = density
            part.held = [(cluster, part.size)]
            for i in part.loose:
                joined[i] = (cluster, density)
            part.loose = []

        ordered = events.sort_values(["w", "event"])
        weights, names = ordered["w"].to_numpy(), ordered["event"].tolist()
        left, right, adds = ordered["a"].tolist(), ordered["b"].tolist(), ordered["adds"].tolist()
        starts = np.flatnonzero(np.r_[True, weights[1:] != weights[:-1]]).tolist()
        for start, end in zip(starts, [*starts[1:], len(names)]):
            weight = float(weights[start])
            density = min(1.0 / weight, MAX_DENSITY) if weight > 0 else MAX_DENSITY
            for e in range(start, end):
                i, j = find(at[left[e]]), find(at[right[e]])
                if i != j:
                    if len(parts[i].loose) < len(parts[j].loose):
                        i, j = j, i
                    boss[j] = i
                    parts[i].absorb(parts[j])
                    parts[j] = None
                parts[i].size += adds[e]
            # Events come in name order, so the first one naming a part gives its cluster id.
            touched: dict[int, int] = {}
            for e in range(start, end):
                touched.setdefault(find(at[left[e]]), names[e])
            for top, name in touched.items():
                settle(parts[top], name, density)

        out = []
        for i, node in enumerate(ids):
            if i in joined:
                (ref_band, ref), density = joined[i]
                out.append((JOINED, band, node, None, ref_band, ref, density, None, None, None))
        for part in parts:
            if part is not None:
                out.extend((LOOSE, band, ids[i], part.name, None, None, None, None, None, None) for i in part.loose)
                for (ref_band, ref), _ in part.held:
                    out.append((HELD, band, part.name, None, ref_band, ref, None, None, None, None))
        for cluster, mass in gained.items():
            out.append((GAINED, band, None, None, *cluster, born.get(cluster), None, mass, None))
        for cluster, parent, density, points in ended:
            out.append((ENDED, band, None, None, *cluster, density, points, None, parent))
        # Object columns first: a float detour would round large ids.
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in SWEPT.split(", ")], dtype=object)
        frame[["kind"]] = frame[["kind"]].astype("int32")
        frame[["band", "ref_band"]] = frame[["band", "ref_band"]].astype("Int32")
        frame[["node", "target", "ref", "size", "parent"]] = frame[["node", "target", "ref", "size", "parent"]].astype("Int64")
        return frame.astype({"density": "float64", "mass": "float64"})

    return kernel


def swept(events: DataFrame, nodes: DataFrame, group_edges: int, bands: int, min_cluster_size: int) -> DataFrame:
    """All bands at once, each in one group; a crowded level of equal weights in one group per connected part."""
    events, nodes = events.withColumn("part", F.lit(0).cast("long")), nodes.withColumn("part", F.lit(0).cast("long"))
    if bands > 1:
        # A row per band.
        crowds = [r.band for r in events.groupBy("band").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * group_edges).collect()]
        if crowds:
            crowded = F.col("band").isin(crowds)
            part = components(events.filter(crowded & (F.col("a") != F.col("b"))).select("band", "a", "b"), by=["band"])
            to = part.select("band", "node", F.col("root").alias("_part"))
            # A node that only gains copies is a part of its own.
            nodes = nodes.join(to, ["band", "node"], "left").withColumn("part", F.when(crowded, F.coalesce("_part", "node")).otherwise(F.col("part"))).drop("_part")
            ends = to.withColumnRenamed("node", "a")
            events = events.join(ends, ["band", "a"], "left").withColumn("part", F.when(crowded, F.coalesce("_part", "a")).otherwise(F.col("part"))).drop("_part")
    kernel = _sweep(min_cluster_size)

    def run(of_nodes: pd.DataFrame, of_events: pd.DataFrame) -> pd.DataFrame:
        return kernel(of_nodes, of_events)

    keys = ["band", "part"]
    return materialize(nodes.groupBy(*keys).cogroup(events.groupBy(*keys)).applyInPandas(run, SWEPT), "swept")


# --- names across bands ---------------------------------------------------------------------------


def _resolve(links: DataFrame, payload: list[str]) -> DataFrame:
    """``links`` (band, node, up_band, up_node, *payload) with the payload of the last row up the links.

    Every write doubles how far up a row looks.
    """
    while True:
        upper = links.select(F.col("band").alias("up_band"), F.col("node").alias("up_node"), F.col("up_band").alias("_band"), F.col("up_node").alias("_node"), *[F.col(c).alias(f"_{c}") for c in payload])
        stepped = links.join(upper, ["up_band", "up_node"], "left")
        links, left = materialize_counted(
            stepped.select("band", "node", F.col("_band").alias("up_band"), F.col("_node").alias("up_node"), *[F.coalesce(c, f"_{c}").alias(c) for c in payload]),
            "names",
            F.count_if(F.col("up_band").isNotNull()),
        )
        if not left:
            return links.select("band", "node", *payload)


def named(found: DataFrame, nodes: DataFrame, bands: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``joined`` (node, cluster, density), ``gained`` (cluster, mass, born) and ``ended`` (cluster, parent, density, size) by real names."""
    joined = found.filter(F.col("kind") == JOINED).select("band", "node", "ref_band", "ref", "density")
    gained = found.filter(F.col("kind") == GAINED).select("ref_band", "ref", "mass", F.col("density").alias("born"))
    ended = found.filter(F.col("kind") == ENDED).select("ref_band", "ref", "parent", "density", "size")
    if bands == 1:
        # Nothing was contracted: every node is a point, and no cluster has a stand-in.
        real = lambda df: df.withColumnRenamed("ref", "cluster").drop("ref_band")
        return real(joined).drop("band"), real(gained), real(ended)
    following = F.lead("band").over(Window.partitionBy("node").orderBy("band"))
    after = nodes.select("band", "node", following.alias("next_band"))
    # A stand-in (band, node) is what the node's part held at the end of the node's previous band.
    held = found.filter(F.col("kind") == HELD).select("band", "node", "ref_band", "ref").join(after, ["band", "node"]).filter("next_band IS NOT NULL")
    links = held.select(
        F.col("next_band").alias("band"), "node", F.col("ref_band").alias("up_band"),
        F.when(F.col("ref_band").isNotNull(), F.col("ref")).alias("up_node"), F.when(F.col("ref_band").isNull(), F.col("ref")).alias("cluster"),
    )
    names = _resolve(links, ["cluster"]).select(F.col("band").alias("ref_band"), F.col("node").alias("ref"), F.col("cluster").alias("_cluster"))
    real = lambda df: df.join(names, ["ref_band", "ref"], "left").withColumn("cluster", F.coalesce("_cluster", "ref")).drop("_cluster", "ref", "ref_band")
    joined, gained, ended = real(joined), real(gained), real(ended)
    # A point that stays loose goes on as its part, which has fewer than a cluster's points.
    loose = found.filter(F.col("kind") == LOOSE).select("band", "node", F.col("target").alias("up_node"))
    onward = loose.join(after.select("band", F.col("node").alias("up_node"), F.col("next_band").alias("up_band")), ["band", "up_node"], "left")
    none = lambda kind: F.lit(None).cast(kind)
    steps = onward.select("band", "node", "up_band", F.when(F.col("up_band").isNotNull(), F.col("up_node")).alias("up_node"), none("long").alias("cluster"), none("double").alias("density"))
    steps = steps.unionByName(joined.select("band", "node", none("int").alias("up_band"), none("long").alias("up_node"), "cluster", "density"))
    first = nodes.groupBy("node").agg(F.min("band").alias("band"))
    placed = _resolve(steps, ["cluster", "density"]).join(first, ["band", "node"], "left_semi")
    return placed.filter("cluster IS NOT NULL").select("node", "cluster", "density"), gained, ended


# --- choice of clusters ---------------------------------------------------------------------------

FOLDED = "cluster long, below double"
CHOSEN = "cluster long, chosen long"


def _below(clusters: list[int], parents: list[int], stability: list[float], base: list[float], floor: list[float], shift: list[float]) -> dict[int, float]:
    """What the descendants of every cluster offer; a cluster gives its parent ``max(floor, shift + best)``."""
    kids: dict[int, list[int]] = {}
    for i, p in enumerate(parents):
        kids.setdefault(p, []).append(i)
    inside = set(clusters)
    order = [i for p in kids if p not in inside for i in kids[p]]
    for i in order:
        order.extend(kids.get(clusters[i], ()))
    at = {c: i for i, c in enumerate(clusters)}
    offered = list(base)
    for i in reversed(order):
        if parents[i] in inside:
            offered[at[parents[i]]] += max(floor[i], shift[i] + max(stability[i], offered[i]))
    return dict(zip(clusters, offered))


def _choose(frame: pd.DataFrame) -> pd.DataFrame:
    """The topmost kept cluster above each one of a whole tree, itself included."""
    clusters, parents, stability = frame["cluster"].tolist(), frame["parent"].tolist(), frame["stability"].tolist()
    zero = [0.0] * len(clusters)
    below = _below(clusters, parents, stability, zero, [NEVER] * len(clusters), zero)
    parent = dict(zip(clusters, parents))
    keep = {c: s >= below[c] for c, s in zip(clusters, stability)}
    top: dict[int, int | None] = {}
    for c in clusters:
        path = []
        while c in parent and c not in top:
            path.append(c)
            c = parent[c]
        for c in reversed(path):
            above = top.get(parent[c])
            top[c] = above if above is not None else c if keep[c] else None
    out = pd.DataFrame({"cluster": clusters, "chosen": [top[c] for c in clusters]}, dtype=object)
    return out.astype({"cluster": "int64", "chosen": "Int64"})


def _folded(frame: pd.DataFrame) -> pd.DataFrame:
    names = ["cluster", "parent", "stability", "base", "floor", "shift"]
    below = _below(*[frame[n].tolist() for n in names])
    return pd.DataFrame({"cluster": list(below), "below": list(below.values())})


def offered_below(tree: DataFrame, count: int, group: int) -> DataFrame:
    """``(cluster, stability, below)`` of a cluster tree (cluster, parent, stability) of any size and depth.

    Each round removes the leaves, whose offer is known, and the chains of clusters with one child left, whose offer
    is a function ``max(floor, shift + best of the cluster below the chain)``; what is left at least halves.
    """
    zero, never = F.lit(0.0), F.lit(NEVER)
    active = tree.select("cluster", "parent", "stability", zero.alias("base"), never.alias("floor"), zero.alias("shift"))
    done: list[DataFrame] = []
    chains: list[DataFrame] = []
    while count > group:
        parents = active.select(F.col("parent").alias("cluster")).distinct()
        leaves = active.join(parents, "cluster", "left_anti")
        done.append(leaves.select("cluster", F.col("base").alias("below")))
        gift = F.greatest("floor", F.col("shift") + F.greatest("stability", "base"))
        gifts = leaves.groupBy(F.col("parent").alias("cluster")).agg(F.sum(gift).alias("gift"))
        inner = active.join(parents, "cluster", "left_semi").join(gifts, "cluster", "left")
        active = materialize(inner.select("cluster", "parent", "stability", (F.col("base") + F.coalesce("gift", zero)).alias("base"), "floor", "shift"), "inner-clusters")
        # A chain cluster's offer from below as a function of its only child's best.
        only = active.groupBy(F.col("parent").alias("cluster")).agg(F.count("*").alias("n"), F.max(F.struct(F.col("cluster").alias("down"), F.col("floor").alias("f"), F.col("shift").alias("s"))).alias("k"))
        chain = active.join(only.filter("n = 1"), "cluster").select("cluster", "stability", F.col("k.down").alias("down"), (F.col("base") + F.col("k.f")).alias("a"), (F.col("base") + F.col("k.s")).alias("b"))
        chain, long = materialize_counted(chain, "chain-clusters")
        while long:
            lower = chain.select(F.col("cluster").alias("down"), F.col("down").alias("next"), F.col("a").alias("c"), F.col("b").alias("d"), F.col("stability").alias("own"))
            passed = F.greatest("a", F.col("b") + F.greatest("own", "c"))
            stepped = chain.join(lower, "down", "left").select(
                "cluster", "stability", F.coalesce("next", "down").alias("down"),
                F.when(F.col("next").isNull(), F.col("a")).otherwise(passed).alias("a"), F.when(F.col("next").isNull(), F.col("b")).otherwise(F.col("b") + F.col("d")).alias("b"),
                F.col("next").isNotNull().alias("moved"),
            )
            chain, long = materialize_counted(stepped, "chain-clusters", F.count_if("moved"))
            chain = chain.drop("moved")
        chains.append(chain.select("cluster", "down", "a", "b"))
        # The cluster below a chain takes the place of the chain's top.
        members = chain.select(F.col("cluster").alias("parent"))
        tops = chain.join(active.select("cluster", "parent", "floor", "shift"), "cluster").join(members, "parent", "left_anti")
        gives = F.greatest("floor", F.col("shift") + F.greatest("stability", "a"))
        moved = tops.select(F.col("down").alias("cluster"), F.col("parent").alias("_parent"), gives.alias("_floor"), (F.col("shift") + F.col("b")).alias("_shift"))
        rest = active.join(chain.select("cluster"), "cluster", "left_anti").join(moved, "cluster", "left")
        active, count = materialize_counted(
            rest.select("cluster", F.coalesce("_parent", "parent").alias("parent"), "stability", "base", F.coalesce("_floor", "floor").alias("floor"), F.coalesce("_shift", "shift").alias("shift")),
            "active-clusters",
        )
    known = _union([_in_one_group(active, _folded, FOLDED), *done])
    own = tree.select("cluster", "stability")
    for chain in reversed(chains):
        # The cluster below a chain outlived it, so its offer is known by now.
        best = materialize(known.join(own, "cluster"), "known-clusters")
        known = best.select("cluster", "below")
        ends = best.select(F.col("cluster").alias("down"), F.greatest("stability", "below").alias("best"))
        known = known.unionByName(chain.join(ends, "down").select("cluster", F.greatest("a", F.col("b") + F.col("best")).alias("below")))
    return known.join(own, "cluster")


def _in_one_group(rows: DataFrame, function, schema: str) -> DataFrame:
    """``function`` over all ``rows``, whose number the caller has bounded."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return function(frame)

    return rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, schema)


def _union(frames: list[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def topmost_kept(kept: DataFrame) -> DataFrame:
    """``(cluster, chosen)`` from (cluster, parent, keep): the topmost kept cluster on the way up, itself included.

    Each step looks twice as far up and remembers the highest kept cluster seen so far.
    """
    own = F.when(F.col("keep"), F.col("cluster"))
    current = materialize(kept.select("cluster", F.col("parent").alias("up"), own.alias("chosen")), "ancestors")
    while True:
        above = current.select(F.col("cluster").alias("up"), F.col("up").alias("next"), F.col("chosen").alias("higher"))
        stepped = current.join(above, "up", "left").select("cluster", F.col("next").alias("up"), F.coalesce("higher", "chosen").alias("chosen"))
        current, open_ends = materialize_counted(stepped, "ancestors", F.count_if(F.col("up").isNotNull()))
        if not open_ends:
            return current.select("cluster", "chosen")


def chosen_clusters(tree: DataFrame, count: int, group: int) -> DataFrame:
    """``(cluster, chosen)`` of a cluster tree (cluster, parent, stability): the topmost cluster worth keeping."""
    if count <= group:
        return _in_one_group(tree, _choose, CHOSEN)
    offers = offered_below(tree, count, group)
    kept = tree.select("cluster", "parent").join(offers, "cluster")
    return topmost_kept(kept.select("cluster", "parent", (F.col("stability") >= F.col("below")).alias("keep")))


# --- the whole ------------------------------------------------------------------------------------


def flat_clusters(tree: DataFrame, cores: DataFrame, min_cluster_size: int, group_edges: int) -> DataFrame:
    """``(id, chosen, probability)`` of the points in a chosen cluster, from a spanning tree (x, y, w) and ``cores`` (id, copies, core).

    The probability is the density at which a point joined, as a share of the densest its cluster has been.
    """
    merges = tree.select("w", F.col("x").alias("a"), F.col("y").alias("b"), F.lit(0).cast("long").alias("adds"))
    # Copies of a vector reach each other at its core distance: such a point starts empty and gets them all then.
    several = F.col("copies") > 1
    arrivals = cores.filter(several).select(F.col("core").alias("w"), F.col("id").alias("a"), F.col("id").alias("b"), F.col("copies").alias("adds"))
    events, count = materialize_counted(merges.unionByName(arrivals).withColumn("event", F.monotonically_increasing_id()), "events")
    events, bands = banded(events, count, group_edges)
    points = cores.select(F.col("id").alias("node"), F.when(several, 0).otherwise(1).cast("long").alias("size"))
    events, nodes = contracted(events, points, bands)
    found = swept(events, nodes, group_edges, bands, min_cluster_size)
    joined, gained, ended = named(found, nodes, bands)
    sums = gained.groupBy("cluster").agg(F.sum("mass").alias("mass"), F.max("born").alias("born"))
    stability = (F.col("mass") - F.col("size") * F.col("density")).alias("stability")
    condensed, clusters = materialize_counted(ended.join(sums, "cluster").select("cluster", "parent", stability, "born"), "condensed")
    if not clusters:
        return joined.select(F.col("node").alias("id"), F.col("cluster").alias("chosen"), F.col("density").alias("probability")).limit(0)
    # The last cluster, the root, never ends and is never chosen.
    chosen = chosen_clusters(condensed.select("cluster", "parent", "stability"), clusters, group_edges).filter("chosen IS NOT NULL")
    densest = condensed.select(F.col("cluster").alias("chosen"), "born")
    share = F.least("density", "born") / F.col("born")
    return joined.join(chosen.join(densest, "chosen"), "cluster").select(F.col("node").alias("id"), "chosen", share.alias("probability"))
