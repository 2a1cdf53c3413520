"""Brute-force twins used by the tests; plain Python over small inputs."""

from __future__ import annotations

import numpy as np

MAX_DENSITY = 1e12


def hdbscan(vectors: np.ndarray, min_cluster_size: int, min_samples: int) -> list[int]:
    return memberships(vectors, min_cluster_size, min_samples)[0]


def memberships(vectors: np.ndarray, min_cluster_size: int, min_samples: int) -> tuple[list[int], list[float]]:
    """Labels and membership probabilities by merging all equal weights at once, over the full distance matrix."""
    n = len(vectors)
    gaps = np.round(np.sqrt(((vectors[:, None, :] - vectors[None, :, :]) ** 2).sum(2)), 12)
    samples = max(1, min(n - 1, min_samples))
    core = np.sort(gaps, axis=1)[:, samples]
    reach = np.maximum(np.maximum(gaps, core[:, None]), core[None, :])
    levels = np.unique(reach[np.triu_indices(n, 1)])
    part = {i: frozenset([i]) for i in range(n)}
    clusters: list[dict] = []
    live: dict[frozenset, int] = {}
    joined: dict[int, float] = {}
    for level in levels:
        density = min(1 / level, MAX_DENSITY) if level > 0 else MAX_DENSITY
        seen: set[int] = set()
        for start in range(n):
            if start in seen:
                continue
            group, stack = {start}, [start]
            while stack:
                for j in np.flatnonzero(reach[stack.pop()] <= level):
                    if int(j) not in group:
                        group.add(int(j))
                        stack.append(int(j))
            seen |= group
            new = frozenset(group)
            old = {part[i] for i in group}
            if old == {new}:
                continue
            kids = [live[p] for p in old if p in live]
            if len(new) >= min_cluster_size:
                loose = [i for p in old if p not in live for i in p]
                if len(kids) == 1:
                    me = kids[0]
                    clusters[me]["mass"] += len(loose) * density
                else:
                    me = len(clusters)
                    clusters.append({"mass": len(new) * density, "kids": kids, "points": [], "end": 0.0, "size": 0, "born": density})
                    for k in kids:
                        clusters[k]["end"] = density
                clusters[me]["points"] += loose
                joined.update((i, density) for i in loose)
                clusters[me]["size"] = len(new)
                live[new] = me
            for i in group:
                part[i] = new
    if not clusters:
        return [-1] * n, [0.0] * n
    best, keep = {}, {}
    for c, cluster in enumerate(clusters):
        stability = cluster["mass"] - cluster["size"] * cluster["end"]
        below = sum(best[k] for k in cluster["kids"])
        keep[c], best[c] = stability >= below, max(stability, below)
    parent = {k: c for c, cluster in enumerate(clusters) for k in cluster["kids"]}
    root = len(clusters) - 1
    owner: dict[int, int] = {}
    for c, cluster in enumerate(clusters):
        at, top = c, None
        while at != root:
            if keep[at]:
                top = at
            at = parent[at]
        if top is not None:
            for i in cluster["points"]:
                owner[i] = top
    first: dict[int, int] = {}
    for i in sorted(owner):
        first.setdefault(owner[i], len(first))
    labels = [first[owner[i]] if i in owner else -1 for i in range(n)]
    shares = [min(1.0, joined[i] / clusters[owner[i]]["born"]) if i in owner else 0.0 for i in range(n)]
    return labels, shares
