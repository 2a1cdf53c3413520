"""Embedding whitening against a plain computation, with copies, odd rows and vectors of several lengths."""

from __future__ import annotations

import math

import numpy as np
import pytest

from cairnflow.llm import whitening
from cairnflow.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, key string, component int, n int"


def brute(rows, weight="one"):
    """{(id, x): (n, deviation, whitened values, explained)} per distinct row, lengths apart."""
    kept = []
    for i, v in rows:
        if v is None or any(c is None or not math.isfinite(c) or not -(2**63) <= math.floor(256 * c) < 2**63 for c in v):
            continue
        kept.append((i, tuple(math.floor(256 * c) for c in v)))
    found = {}
    for d in {len(x) for _, x in kept}:
        here = [(i, x) for i, x in kept if len(x) == d]
        distinct = sorted({x for _, x in here})
        n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
        w = np.array([1 if weight == "one" else sum(x == y for _, y in here) for x in distinct], float)
        data = np.array(distinct, float).reshape(n, d)
        mean = (data * w[:, None]).sum(0) / w.sum()
        cov = ((data - mean) * w[:, None]).T @ (data - mean) / w.sum()
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
        for i, x in here:
            deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
            z = [(np.array(x, float) - mean) @ vectors[:, c] / math.sqrt(values[c]) if values[c] > 1e-9 else None for c in range(min(4, d))]
            found.setdefault((i, d), []).append((n, deviation, z, [v / np.trace(cov) if np.trace(cov) else None for v in values]))
    return found


def check(rows, got, weight="one", close=1e-6):
    want = brute(rows, weight)
    by_row = {}
    for r in got:
        by_row.setdefault(r.component, []).append(r)
        assert r.identity_error is None or r.identity_error <= 1e-4
    for c in range(1, 5):
        expected = [(i, e[0], e[1], e[2][c - 1], e[3][c - 1]) for (i, d), es in want.items() for e in es if d >= c]
        mine = [(r.vec_id, r.n, r.deviation, r.whitened, r.explained) for r in by_row.get(c, [])]
        assert len(expected) == len(mine)
        order = lambda t: (t[0] is None, t[0] or 0, t[1], t[2] or 0, abs(t[3] or 0))
        flips = set()
        for a, b in zip(sorted(expected, key=order), sorted(mine, key=order)):
            assert (a[0], a[1]) == (b[0], b[1]) and (b[2] == a[2] if a[2] < 2**63 else b[2] is None)
            if a[3] is None:
                assert b[3] is None
            elif abs(a[3]) > 1e-3:
                flips.add((a[1], round(b[3] / a[3], 6)))
                assert math.isclose(abs(a[3]), abs(b[3]), rel_tol=close)
            assert (a[4] is None) == (b[4] is None) and (a[4] is None or math.isclose(a[4], b[4], rel_tol=1e-4, abs_tol=1e-12))
        # Either sign, but one for all rows of a space.
        assert len(flips) == len({n for n, _ in flips}) and {abs(s) for _, s in flips} <= {1.0}


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "k", 2, 3) for i, v in rows], SCHEMA).repartition(5)


def vectors(seed, n, d, spread=1.0):
    rnd = np.random.default_rng(seed)
    scale = np.linspace(1, 3, d) * spread
    return [[float(np.float32(c)) for c in row] for row in rnd.normal(size=(n, d)) * scale + 1]


@pytest.mark.parametrize("weight", ["one", "count"])
def test_copies_nulls_and_bad_entries(spark, weight):
    made = vectors(1, 60, 6)
    rows = [(i if i % 11 else None, v) for i, v in enumerate(made)] + [(500 + i, made[7]) for i in range(90)] + [(3, made[3]), (3, made[4])]
    rows += [(900, None), (901, [None] * 6), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5), (905, [3e38] * 6)]
    got = whitening.inspect(frame(spark, rows), weight)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(rows, got.collect(), weight)


def test_lengths_are_spaces_of_their_own(spark):
    rows = list(enumerate(vectors(2, 40, 5) + vectors(3, 30, 2) + vectors(4, 9, 64, 40.0))) + [(100, []), (101, []), (102, [2.0] * 7), (103, [2.0] * 7)]
    check(rows, whitening.inspect(frame(spark, rows)).collect(), close=1e-5)


def test_wide_values_and_overflow(spark):
    rows = list(enumerate(vectors(5, 50, 3, 1e5))) + list(enumerate(vectors(6, 20, 4, 1e12)))
    check(rows, whitening.inspect(frame(spark, rows)).collect())


def test_constant_vectors_have_no_components_with_variance(spark):
    got = whitening.inspect(frame(spark, [(i, [0.5, -0.5, 0.0]) for i in range(20)])).collect()
    assert len(got) == 60 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, None, None)}


def test_empty_table(spark):
    assert whitening.inspect(frame(spark, [(1, None)])).collect() == []
    assert whitening.inspect(frame(spark, [(1, [1.0])]).limit(0)).collect() == []


def test_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, "/root/testdata/sf0.01", "embeddings").collect()]
    check(rows, whitening.inspect(table(spark, "/root/testdata/sf0.01", "embeddings")).collect())


def test_keys_are_exact():
    for x in ([], [0], [-128, 127], [128], [-32769, 5], [2**31], [-(2**63), 2**63 - 1]):
        assert whitening.from_key(whitening.to_key(np.array(x, np.int64))).tolist() == x
