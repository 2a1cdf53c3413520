"""The condensed tree in many bands and the choice of clusters on deep trees, against plain recursion."""

from __future__ import annotations

import random

import numpy as np
import pytest
from brute import memberships as brute

from cairnflow.operators import hierarchy
from cairnflow.operators.density import memberships


def points(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vector array<double>")


def shapes(kind):
    rng = np.random.default_rng(11)
    if kind == "blobs with copies and ties":
        lattice = rng.integers(0, 7, size=(60, 2)).astype(float)
        return np.vstack([np.tile([3.0, 3.0], (30, 1)), lattice, rng.normal([12, 0], 0.4, size=(25, 2))])
    if kind == "chain of growing gaps":
        return np.cumsum(np.r_[0, 1.01 ** np.arange(70)])[:, None]
    if kind == "nested blobs":
        return np.vstack([rng.normal([x * s, s], s * 0.02 + 0.05, size=(12, 2)) for x in (0, 4) for s in (1, 6, 30, 150)])
    return rng.normal(size=(90, 3))


@pytest.mark.parametrize(
    "kind, group_edges, size",
    [("nested blobs", 500_000, 4), ("blobs with copies and ties", 13, 4), ("chain of growing gaps", 13, 4), ("noise", 5, 2), ("nested blobs", 5, 2)],
)
def test_memberships_equal_brute_force_in_one_and_in_many_bands(spark, kind, group_edges, size):
    vectors = shapes(kind)
    got = memberships(points(spark, vectors), size, 3, listed=5, block_rows=50, group_edges=group_edges).orderBy("id").collect()
    labels, shares = brute(vectors, size, 3)
    assert [r.cluster_id for r in got] == labels
    assert np.allclose([r.probability for r in got], shares, rtol=0, atol=1e-9)
    assert all((r.probability == 0) == (r.cluster_id == -1) for r in got)


def trees():
    rnd = random.Random(4)
    deep = [(i, i - 1) for i in range(1, 200)]
    mixed = [(i, rnd.choice([i - 1, i - 1, i - 1, rnd.randrange(i)])) for i in range(1, 300)]
    wide = [(i, rnd.randrange(max(1, i // 8))) for i in range(1, 200)]
    for edges in (deep, mixed, wide):
        yield [(c, p, round(rnd.random() * rnd.choice([1, 10]), 3)) for c, p in edges]


@pytest.mark.parametrize("rows", list(trees()))
def test_choice_in_rounds_equals_choice_in_one_group(spark, rows):
    tree = spark.createDataFrame(rows, "cluster long, parent long, stability double").repartition(3)
    one = {r.cluster: r.chosen for r in hierarchy.chosen_clusters(tree, len(rows), 1000).collect()}
    many = {r.cluster: r.chosen for r in hierarchy.chosen_clusters(tree, len(rows), 3).collect()}
    kids = {}
    for c, p, s in rows:
        kids.setdefault(p, []).append(c)
    own, parent, below = {c: s for c, _, s in rows}, {c: p for c, p, _ in rows}, {}
    for c in sorted(own, reverse=True):
        below[c] = sum(max(own[k], below[k]) for k in kids.get(c, ()))
    want = {}
    for c in sorted(own):
        want[c] = want.get(parent[c]) or (c if own[c] >= below[c] else None)
    assert one == want and many == want
