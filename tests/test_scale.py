"""What a task holds and what travels does not grow with files, blocks or cells."""

from __future__ import annotations

import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnflow.functions import vectors
from cairnflow.functions.text import counted_words
from cairnflow.llm import lm_scoring
from cairnflow.operators import approximate, blocks, classify, density
from cairnflow.plans import store
from cairnflow.schemas import SOURCE_ITEMS


def peak(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def frame(rng, rows, width, **more):
    return pd.DataFrame({"id": np.arange(rows), "vector": list(rng.normal(size=(rows, width))), **more})


def test_block_kernels_hold_slices_of_a_table():
    rng = np.random.default_rng(1)
    # A whole table of 3,000 x 4,000 distances has 96 MB, and its copies as much again.
    queries, rows = frame(rng, 3000, 8, core=0.1, comp=1), frame(rng, 4000, 8, core=0.2, comp=np.arange(4000) % 3)
    assert peak(lambda: blocks.top_k_kernel(5, True)(queries, rows)) < 96
    assert peak(lambda: density._outside_kernel(queries, rows)) < 96
    gaps = ((np.stack(queries.vector)[:, None, :] - np.stack(rows.vector)[None, :50]) ** 2).sum(2) ** 0.5
    got = blocks.top_k_kernel(3, False)(queries, rows.head(50))
    assert (got.neighbour.to_numpy().reshape(-1, 3) == np.argsort(gaps, axis=1)[:, :3]).all()


def test_blocks_of_short_vectors_hold_more_rows(spark):
    rows = spark.range(5000).select("id", F.array(*[F.rand(i) for i in range(4)]).alias("vector"))
    assert blocks.sized_blocks(rows, blocks.BLOCK_ROWS) == blocks.BLOCK_BYTES // 32
    assert blocks.sized_blocks(rows, 20) == 20 and blocks.sized_blocks(rows.limit(0), blocks.BLOCK_ROWS) == blocks.BLOCK_ROWS
    wide = rows.select("id", F.array_repeat(F.lit(0.5), 4096).alias("vector"))
    assert blocks.sized_blocks(wide, blocks.BLOCK_ROWS) == blocks.BLOCK_ROWS


def test_a_query_goes_once_to_the_codes_of_all_its_cells(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(600, 8))
    base = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vector array<double>")
    placed, cells = blocks.partition(base, 20, rows=600)
    assert cells.block_count > 25
    visits = approximate.probed(base, cells, 12).collect()
    filled = np.where(cells.blocks > 0, 0.0, np.inf)
    nearest = np.argsort(blocks.distances(vectors, cells.pivots) + filled, axis=1)[:, :12]
    found = {}
    for v in visits:
        found.setdefault(v.id, []).append(v)
    assert set(found) == set(range(600)) and all(len(v) == 1 for v in found.values())
    assert all(set(found[i][0].places) == set(nearest[i].tolist()) for i in range(600))
    # Only rows of the cells that a query visits become its candidates.
    codes = approximate.coded(approximate.bundled(placed.select("id", "vector", "cell", "block"), cells), approximate.fit_centres(base)).toPandas()
    home = codes.set_index("id").place
    asked = pd.DataFrame([{"id": v.id, "vector": np.array(v.vector), "places": np.array(v.places)} for v in visits])
    got = approximate._estimates(approximate.fit_centres(base), 40, approximate.PART)(asked, codes)
    assert got.groupby("id").size().max() == 40
    assert all(home[n] in found[i][0].places for i, n in zip(got.id, got.neighbour))


def plain_nearest(gaps, others, k):
    return [[(int(others[c]), float(row[c])) for c in np.lexsort((others, row))[:k] if np.isfinite(row[c])] for row in gaps]


def spread_out(kind):
    rng = np.random.default_rng(4)
    if kind == "lattice":
        return rng.integers(0, 3, size=(700, 3)).astype(float), rng.integers(0, 3, size=(2500, 3)).astype(float)
    if kind == "equal":
        return np.ones((5, 4)), np.ones((2300, 4))
    base = rng.normal(size=(2500, 6))
    # Far from the origin, and nearer to each other than short floats can tell apart.
    return (base[:600] * 1e-4 + 1e3, base * 1e-4 + 1e3) if kind == "far" else (base[:600] * 1e-5, np.vstack([base * 1e-5, [[9.0] * 6]]))


@pytest.mark.parametrize("kind", ["lattice", "equal", "far", "near"])
def test_tiles_of_scores_give_the_exact_answers(kind):
    left, right = spread_out(kind)
    others = np.random.default_rng(5).permutation(len(right)) + 10
    gaps = np.round(np.sqrt(((left[:, None] - right[None]) ** 2).sum(2)), 12)
    queries = pd.DataFrame({"id": others[: len(left)], "vector": list(left)})
    rows = pd.DataFrame({"id": others, "vector": list(right)})
    listed = lambda got: [list(zip(g.neighbour, g.distance)) for _, g in got.groupby(np.repeat(np.arange(len(left)), 7))]
    assert listed(blocks.top_k_kernel(7, False)(queries, rows)) == plain_nearest(gaps, others, 7)
    apart = np.where(queries.id.to_numpy()[:, None] == others[None], np.inf, gaps)
    assert listed(blocks.top_k_kernel(7, True)(queries, rows)) == plain_nearest(apart, others, 7)


def test_a_visit_gives_a_row_per_query_and_nothing_beyond_its_bound():
    rng = np.random.default_rng(6)
    queries, rows = frame(rng, 300, 5), frame(rng, 5000, 5)
    gaps = np.round(np.sqrt(((np.stack(queries.vector)[:, None] - np.stack(rows.vector)[None]) ** 2).sum(2)), 12)
    bound = np.sort(gaps, axis=1)[np.arange(300), np.arange(300) % 9]
    got = blocks.packing(blocks.top_k_kernel(6, False))(queries.assign(bound=bound), rows)
    assert got.id.tolist() == list(range(300))
    assert [len(n) for n in got.neighbours] == [min(6, i % 9 + 1) for i in range(300)]
    assert all((d <= b).all() for d, b in zip(got.distances, bound))


def count_measured(monkeypatch, *modules):
    measured = Counter()

    def counting(left, right, direct=blocks.exact_distances):
        measure = direct(left, right)
        return lambda row, column: measured.update(pairs=len(row)) or measure(row, column)

    for module in modules:
        monkeypatch.setattr(module, "exact_distances", counting)
    return measured


def test_few_pairs_of_a_block_are_measured_one_by_one(monkeypatch):
    rng = np.random.default_rng(7)
    measured = count_measured(monkeypatch, blocks)
    blocks.top_k_kernel(16, True)(frame(rng, 1000, 32), frame(rng, 20_000, 32))
    assert 16 * 1000 <= measured["pairs"] < 40 * 1000


def test_a_search_beyond_the_lists_measures_few_pairs_and_keeps_to_its_bound(monkeypatch):
    rng = np.random.default_rng(7)
    measured = count_measured(monkeypatch, density)
    queries = frame(rng, 1000, 32, core=0.1, comp=np.arange(1000) % 3)
    rows = frame(rng, 20_000, 32, core=0.2, comp=np.arange(20_000) % 3)
    got = density._outside_kernel(queries, rows)
    assert 1000 <= measured["pairs"] < 40 * 1000
    gaps = blocks.distances(np.stack(queries.vector), np.stack(rows.vector))
    gaps[queries.comp.to_numpy()[:, None] == rows.comp.to_numpy()[None]] = np.inf
    assert got.neighbour.tolist() == gaps.argmin(1).tolist() and np.allclose(got.w, gaps.min(1), rtol=0, atol=1e-9)
    half = got.w.median()
    within = density._outside_kernel(queries.assign(bound=half), rows)
    assert within.id.tolist() == got.id[got.w <= half].tolist()


@pytest.mark.parametrize("kind", ["lattice", "equal", "far", "near"])
def test_the_nearest_of_another_component_is_exact(kind):
    left, right = spread_out(kind)
    rng = np.random.default_rng(5)
    others = rng.permutation(len(right)) + 10
    core_l, core_r = rng.random(len(left)) * 1e-4, rng.random(len(right)) * 1e-4
    comp_l, comp_r = rng.integers(0, 4, len(left)), rng.integers(0, 4, len(right))
    values = np.round(np.sqrt(((left[:, None] - right[None]) ** 2).sum(2)), 12)
    values = np.maximum(np.maximum(values, core_l[:, None]), core_r[None])
    values[comp_l[:, None] == comp_r[None]] = np.inf
    queries = pd.DataFrame({"id": np.arange(len(left)), "vector": list(left), "core": core_l, "comp": comp_l})
    rows = pd.DataFrame({"id": others, "vector": list(right), "core": core_r, "comp": comp_r})
    want = [n[0] for n in plain_nearest(values, others, 1)]
    for given in (queries, queries.assign(bound=values.min(1))):
        got = density._outside_kernel(given, rows)
        assert list(zip(got.neighbour, got.w)) == want


def test_estimates_are_those_of_the_codes():
    rng = np.random.default_rng(8)
    asked = rng.normal(size=(70, 10))
    centres = [rng.normal(size=(50, d)) for d in (4, 4, 2)]
    codes = rng.integers(0, 50, size=(6000, 3)).astype(np.uint8)
    rows = pd.DataFrame({"id": rng.permutation(6000), "code": [c.tobytes() for c in codes], "place": np.arange(6000) % 4})
    queries = pd.DataFrame({"id": np.arange(70), "vector": list(asked), "places": [np.arange(4)[: 1 + i % 4] for i in range(70)]})
    got = approximate._estimates(centres, 30, 4)(queries, rows)
    parts = [blocks.distances(asked[:, 4 * k : 4 * k + 4], c) ** 2 for k, c in enumerate(centres)]
    total = sum(t[:, codes[:, k]] for k, t in enumerate(parts))
    total[(np.arange(6000) % 4)[None] > (np.arange(70) % 4)[:, None]] = np.inf
    want = plain_nearest(total, rows.id.to_numpy(), 30)
    assert [list(zip(g.neighbour, g.estimate)) for _, g in got.groupby("id")] == want
    # Decoded in long floats, the rows have 41 MB, and the tables of all queries 39.
    wide = [rng.normal(size=(256, 4)) for _ in range(16)]
    many = pd.DataFrame({"id": np.arange(80_000), "code": [bytes(c) for c in rng.integers(0, 256, size=(80_000, 16)).astype(np.uint8)], "place": 0})
    asking = frame(rng, 1200, 64, places=[np.zeros(1, int)] * 1200)
    assert peak(lambda: approximate._estimates(wide, 20, 4)(asking, many)) < 80


def test_answers_of_several_visits_are_merged_by_id(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i) if i else None, rng.integers(0, 50, 6).tolist(), sorted(rng.integers(0, 4, 6).astype(float).tolist())) for i in rng.integers(0, 40, 300)]
    packed = spark.createDataFrame(rows, blocks.PACKED).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = blocks.best_of(packed, 8, blocks.positions, f"{blocks.NEIGHBOURS}, position int").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for i, near, gaps in rows:
        want.setdefault(i, []).extend(zip(gaps, near))
    found = {}
    for r in sorted(got, key=lambda r: r.position):
        found.setdefault(r.id, []).append((r.distance, r.neighbour))
    assert found == {i: sorted(v)[:8] for i, v in want.items()}


def test_a_unit_vector_takes_its_length_once(spark):
    assert str(vectors.normalize(F.col("v"))).count("aggregate(") == 1
    table = spark.createDataFrame([([3.0, 4.0],), ([0.0],), (None,), ([1.0, None],)], "v array<double>")
    assert [r.u for r in table.select(vectors.normalize(F.col("v")).alias("u")).collect()] == [[0.6, 0.8], None, None, None]


def test_words_are_counted_in_bounded_shares(spark):
    rows = [(i % 40 if i % 9 else None, "tool TOOL manual é1 " * (i % 5)) for i in range(200)] + [(500, None), (500, "")]
    table = spark.createDataFrame(rows, "id long, document_text string")
    got, n = counted_words(table, "word", share=500)
    want = Counter()
    for i, text in rows:
        want.update((i, w) for w in (text or "").lower().split())
    assert n == len(rows) and {(r.id, r.word): r.tf for r in got.collect()} == dict(want)
    size = sum(len((t or "").encode()) for _, t in rows)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-size // 500)})" in got._jdf.queryExecution().executedPlan().toString()
    assert counted_words(table.limit(0), "word")[0].collect() == []
    items = table.filter("id IS NOT NULL").withColumn("expected", F.col("id") < 20)
    assert classify.classify_by_counts(items, items).count() == items.count()


def test_a_batch_rewrites_buckets_that_it_reads(spark, tmp_path):
    path = f"file://{tmp_path}/items"
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in SOURCE_ITEMS.fields if f.name not in ("source", "external_id", "author")]
    for author, keys in (("a", range(30)), ("b", range(20, 40))):
        batch = spark.range(min(keys), max(keys) + 1).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("external_id"), F.lit(author).alias("author"), *missing)
        store.apply_batch(path, batch.withColumn("batch_order", F.lit(0)), buckets=4)
        store.apply_batch(path, batch.withColumn("batch_order", F.lit(0)), buckets=4)
    got = {int(r.external_id): r.author for r in store.read_items(spark, path).collect()}
    assert got == {i: "b" if i >= 20 else "a" for i in range(40)} and store.read_items(spark, path).count() == 40
    assert all(f.name.endswith(".zstd.parquet") for f in (tmp_path / "items").rglob("part-*"))


def test_packed_columns_are_read_in_place():
    parts = [[b"\x01\x00\x00\x00", None, b""], [], [None], [b"\x02\x00\x00\x00\x03\x00\x00\x00"]]
    table = pa.table({"x": pa.chunked_array([pa.array(p, pa.binary()) for p in parts])})
    assert lm_scoring.joined(table, "x", np.int32).tolist() == [1, 2, 3]
    assert lm_scoring.joined(table.slice(1), "x", np.int32).tolist() == [2, 3]
    assert lm_scoring.joined(table.slice(0, 0), "x", np.int32).tolist() == []
    assert lm_scoring.joined(pa.table({"x": pa.array([b"", b"\x05\x00\x00\x00"], pa.large_binary())}), "x", np.int32).tolist() == [5]
    some, packed = lm_scoring.blobs(np.array([1, 1, 3]), 5, v=np.array([7, 8, 9]))
    assert some.tolist() == [1, 3] and [np.frombuffer(x, np.int64).tolist() for x in packed["v"].to_pylist()] == [[7, 8], [9]]
    big = pa.table({"x": pa.array([np.arange(1 << 18).tobytes()] * 8, pa.binary())})
    # Once as the result; before, as an object per row and joined besides.
    assert peak(lambda: lm_scoring.joined(big, "x", np.int64)) < 1


def test_pairs_of_one_fold_are_counted_by_word_only(spark):
    """Only pairs of both folds are handed on one by one; the sums of their first words stand for all others."""
    rows = [("a b a b c", 0), ("a b", 3), ("", 1), (None, 2), ("d", 5), ("a x y", 4), ("c c", 1)]
    counted = lm_scoring.count(spark.createDataFrame(rows, "text string, kind int").repartition(3), None, 1, 0)
    code = lambda word: int(lm_scoring.tokens(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word)]))[0].view(np.int64)[0])
    start = int(lm_scoring.START.astype(np.int64))
    found = counted.collect()
    cells = [r for r in found if r.v is not None]
    shared = {(start, code("a"), 1, 0, 0, 1, 1, 0), (code("a"), code("b"), 2, 0, 0, 1, 0, 0)}
    assert len(cells) == 2 and {(r.u, r.v, r.n0, r.n1, r.n2, r.n3, r.n4, r.n5) for r in cells} == shared
    words = {r.code: r.asDict() for r in lm_scoring.word_counts(counted).collect()}
    assert words.keys() == {start, *map(code, "abcdxy")}
    of = lambda x, word: [words[word][f"{x}{k}"] for k in range(6)]
    assert of("c", code("a")) == of("m", code("a")) == [2, 0, 0, 1, 1, 0] and of("c", start) == [0] * 6
    assert of("m", start) == [1, 1, 0, 1, 1, 1] and of("c", code("c")) == [1, 2, 0, 0, 0, 0] and of("m", code("c")) == [0, 1, 0, 0, 0, 0]
    assert [words[code("a")][f"d{k}"] for k in range(4)] == [1, 0, 0, 1] and words[code("d")]["d1"] == 0
    assert [(words[code(w)]["after"], words[code(w)]["before"]) for w in "abc"] == [(1, 1), (0, 1), (0, 0)] and words[start]["after"] == 1


def test_pairs_of_one_key_stay_apart(monkeypatch):
    monkeypatch.setattr(lm_scoring, "pair_keys", lambda before, now: np.zeros(len(before), np.uint64))
    before, now, n = (np.array(x, t) for x, t in (([1, 2, 1, 2], np.uint64), ([3, 3, 3, 3], np.uint64), ([8, 16, 9, 24], np.int64)))
    u, v, counts = lm_scoring.cell_counts(before, now, n)
    assert u.tolist() == [1, 2] and v.tolist() == [3, 3] and counts[:, :2].tolist() == [[1, 1], [5, 0]]
