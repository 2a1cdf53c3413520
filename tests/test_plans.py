"""Density clustering, ingestion batches, stored runs, streams."""

from __future__ import annotations

import json
import time

import numpy as np
import pytest
from brute import hdbscan
from pyspark.sql import functions as F

from cairnflow.catalog import queries
from cairnflow.operators import classify, encode
from cairnflow.operators.density import can_cluster, density_clusters
from cairnflow.plans import analysis, dashboard, ingest, store
from cairnflow.schemas import SOURCE_ITEMS, TREND_STATUSES
from cairnflow.streaming import ingest as stream_ingest
from cairnflow.streaming import volume


def points(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vector array<double>")


def labels(df):
    return [r.cluster_id for r in df.orderBy("id").collect()]


def test_density_equals_brute_force_with_ties_copies_and_small_blocks(spark):
    rng = np.random.default_rng(5)
    lattice = rng.integers(0, 7, size=(60, 2)).astype(float)
    vectors = np.vstack([np.tile([3.0, 3.0], (30, 1)), lattice, rng.normal([12, 0], 0.4, size=(25, 2))])
    got = labels(density_clusters(points(spark, vectors), 4, 3, listed=4, block_rows=20))
    assert got == hdbscan(vectors, 4, 3)


def test_density_guards(spark):
    assert labels(density_clusters(points(spark, [[0.0], [1.0]]), 3)) == [-1, -1]
    assert labels(density_clusters(points(spark, [[1.0]] * 5), 2)) == [-1] * 5
    assert not can_cluster(4, 2, 5) and can_cluster(5, 2, 5)
    for bad in ((1, None, "euclidean"), (2, 0, "euclidean"), (2, None, "cosine")):
        with pytest.raises(ValueError):
            density_clusters(points(spark, [[0.0]]), *bad)


def raw_items(spark, rows):
    return spark.createDataFrame(rows, "external_id string, title string").select(
        "external_id",
        F.lit("s").alias("source"),
        "title",
        F.lit("").alias("body"),
        F.lit("u").alias("url"),
        F.lit(None).cast("string").alias("author"),
        F.timestamp_seconds(F.lit(0)).alias("published_at"),
        F.lit(1).alias("engagement_score"),
        F.lit("{}").alias("raw_payload"),
    )


def topic_rows(start, counts):
    rows = []
    for topic, count in counts.items():
        rows += [(f"{start}{topic}{i}", f"I wish {topic} {topic} {topic} were easier detail{start}{topic}{i}") for i in range(count)]
    return rows + [(f"{start}n{i}", f"release notes {i}") for i in range(3)]


def test_two_runs_end_to_end(spark, tmp_path):
    size = 32
    encoder = lambda df: encode.encode_by_hashing(df, size)
    first = ingest.ingest(
        spark.createDataFrame([], SOURCE_ITEMS), raw_items(spark, topic_rows("a", {"invoices": 6, "deployments": 6, "calendars": 6})), classify.classify_lexically, encoder, size
    )
    total = {r.source: r for r in first.statistics.collect()}[None]
    assert (total.acquired, total.problems, total.embedded, total.non_problems) == (21, 18, 18, 3)
    path = f"{tmp_path}/items"
    store.apply_batch(path, first.classified, buckets=4)
    runs = store.RunStore(spark, f"{tmp_path}/runs")
    parameters = analysis.Parameters(encode.hashing_model_name(size), min_cluster_size=3)
    one = analysis.analyse(store.read_items(spark, path), runs, parameters)
    assert {r.status for r in runs.trends(one).collect()} == {"new"} and runs.run_ids() == [one]

    second = ingest.ingest(store.read_items(spark, path), raw_items(spark, topic_rows("b", {"invoices": 9})), classify.classify_lexically, encoder, size)
    want = sorted(r.external_id for r in second.table.collect())
    store.apply_batch(path, second.classified, buckets=4)
    items = store.read_items(spark, path)
    assert sorted(r.external_id for r in items.collect()) == want
    assert items.count() == 33
    two = analysis.analyse(items, runs, parameters)
    status = {r.label.split(", ")[0]: r.status for r in runs.trends(two).collect()}
    assert status["invoices"] == "rising" and status["deployments"] == "stable"
    row = analysis.summary(items, runs, two).head()
    assert row.embedded == 27 and row.noise == row.embedded - row.assigned

    counts = spark.createDataFrame([(one, 18), (two, 27)], "id long, total_problems long")
    history = store.series_history(runs, parameters.metadata, counts, TREND_STATUSES)
    clusters = runs.clusters(two).withColumnRenamed("id", "cluster_id")
    members = runs.members(two).withColumnRenamed("source_item_id", "item_id").select("cluster_id", "item_id")
    view = dashboard.Snapshot(items, clusters, members, runs.trends(two), runs.runs(), history)
    parts = dashboard.analytics(view, "month")
    assert parts["summary"].head().latest_run_id == two
    assert parts["time_series"].head().total_problems == 45
    top = parts["top_opportunities"].head()
    assert top["rank"] == 1 and top.label.startswith("invoices")
    cluster, documents = dashboard.cluster_detail(view, top.cluster_id, 5)
    assert cluster.count() == 1 and documents.count() == 5 and "embedding" not in documents.columns

    with pytest.raises(ValueError, match="committed"):
        runs.commit(two, parameters.metadata)
    runs.delete_run(two)
    assert runs.run_ids() == [one] and runs.trends(two).isEmpty()


def test_a_batch_leaves_the_files_of_other_buckets_alone(spark, tmp_path):
    path, buckets = f"{tmp_path}/items", 16
    raw = raw_items(spark, [(str(i), f"title {i}") for i in range(200)])
    store.append_new(path, ingest.items.prepare(raw).withColumn("batch_order", F.lit(0)), buckets)
    files = lambda: {f: (f.stat().st_mtime_ns, f.stat().st_size) for f in (tmp_path / "items").rglob("*.parquet")}
    before = files()
    change = raw_items(spark, [("7", "new title"), ("new", "another")])
    store.apply_batch(path, ingest.items.prepare(change), buckets=buckets)
    after = files()
    touched = {r.b for r in change.select(store.bucket_of(buckets).alias("b")).collect()}
    same = {f for f in before if int(f.parent.name.split("=")[1]) not in touched}
    assert len(same) >= 14 and all(after[f] == before[f] for f in same)
    assert all(f not in after for f in before if f not in same)
    rows = {r.external_id: r.title for r in store.read_items(spark, path).collect()}
    assert len(rows) == 201 and rows["7"] == "new title" and rows["8"] == "title 8"
    # A repeated batch changes nothing, known keys are not added again, and appending rewrites no file.
    store.apply_batch(path, ingest.items.prepare(change), buckets=buckets)
    kept = files()
    store.append_new(path, ingest.items.prepare(raw_items(spark, [("7", "x"), ("late", "y")])), buckets)
    assert {r.external_id: r.title for r in store.read_items(spark, path).collect()} == rows | {"late": "y"}
    assert kept.items() <= files().items()
    with pytest.raises(ValueError, match="buckets"):
        store.apply_batch(path, ingest.items.prepare(change), buckets=8)
    assert store.read_items(spark, f"{tmp_path}/nowhere").isEmpty()


def test_keys_of_one_hash_get_ids_of_their_own(spark, tmp_path, monkeypatch):
    """A hash of eight values, so that nearly all keys clash: in one batch, with stored rows, appended and upserted."""
    monkeypatch.setattr(ingest.items, "key_hash", lambda: F.pmod(F.xxhash64("source", "external_id"), F.lit(8)))
    monkeypatch.setattr(store, "key_hash", ingest.items.key_hash)
    path, buckets = f"{tmp_path}/items", 4
    ids = lambda: {r.external_id: r.id for r in store.read_items(spark, path).collect()}
    prepared = lambda names: ingest.items.prepare(raw_items(spark, [(n, "title") for n in names]))
    store.apply_batch(path, prepared([str(i) for i in range(30)]), buckets=buckets)
    first = ids()
    assert len(first) == len(set(first.values())) == 30 and sum(0 <= i < 8 for i in first.values()) <= 8
    store.append_new(path, prepared([str(i) for i in range(20, 45)]), buckets)
    second = ids()
    assert len(second) == len(set(second.values())) == 45 and first.items() <= second.items()
    store.apply_batch(path, prepared([str(i) for i in range(40, 60)]), buckets=buckets)
    third = ids()
    assert len(third) == len(set(third.values())) == 60 and second.items() <= third.items()


def test_an_empty_run_is_recorded(spark, tmp_path):
    runs = store.RunStore(spark, f"{tmp_path}/runs")
    one = analysis.analyse(spark.createDataFrame([], SOURCE_ITEMS), runs, analysis.Parameters("m"))
    assert runs.run_ids() == [one] and runs.clusters(one).isEmpty()
    with pytest.raises(ValueError, match="not be blank"):
        runs.commit(9, {"embedding_model": " ", "min_cluster_size": 2, "min_samples": None, "metric": "euclidean"})


def test_one_failing_source_does_not_stop_the_others(spark):
    def broken():
        raise OSError("no landing folder")

    readers = {"reddit": broken, "github": lambda: raw_items(spark, [("1", "t")])}
    rows, errors = ingest.collect_sources(readers, ["reddit", "github"], fail_fast=False)
    assert rows.count() == 1 and "reddit" in errors
    with pytest.raises(OSError):
        ingest.collect_sources(readers, ["reddit", "github"])


def test_ingest_only_appends_new_keys(spark):
    old = ingest.ingest_only(spark.createDataFrame([], SOURCE_ITEMS), raw_items(spark, [("1", "a"), ("2", "b")]))[0]
    table = ingest.append_rows(spark.createDataFrame([], SOURCE_ITEMS), old)
    fresh, report = ingest.ingest_only(table, raw_items(spark, [("2", "b2"), ("3", "c"), ("3", "c again")]))
    assert [r.external_id for r in fresh.collect()] == ["3"]
    total = {r.source: r for r in report.collect()}["s"]
    assert (total.acquired, total.new_items, total.existing_items) == (3, 1, 2)


def test_stream_ingests_each_key_once_over_restarts(spark, tmp_path):
    landing, table, progress = (str(tmp_path / n) for n in ("landing", "table", "progress"))
    (tmp_path / "landing").mkdir()

    def land(name, ids):
        lines = [json.dumps({"source": "s", "external_id": str(i), "at": "2024-01-01T00:00:00Z"}) for i in ids]
        (tmp_path / "landing" / name).write_text("\n".join(lines))

    def run():
        raw = spark.readStream.schema("source string, external_id string, at timestamp").json(landing).withColumnRenamed("at", "arrived_at")
        stream_ingest.ingest_new(raw, table, progress).awaitTermination()
        return sorted(r.external_id for r in spark.read.parquet(table).collect())

    land("a.json", [1, 2, 2])
    assert run() == ["1", "2"]
    land("b.json", [2, 3])
    assert run() == ["1", "2", "3"]


@pytest.mark.parametrize("granularity, first", [("day", "2025-01-01"), ("week", "2024-12-30"), ("month", "2025-01-01")])
def test_stream_volume(spark, tmp_path, granularity, first):
    (tmp_path / "a.json").write_text('{"ts":"2025-01-01T08:00:00Z"}\n{"ts":"2025-01-01T09:00:00Z"}')
    stream = spark.readStream.schema("ts timestamp").json(str(tmp_path))
    name = f"volume_{granularity}"
    query = volume.problem_volume(stream, granularity).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    counts = volume.monthly(spark.table(name)) if granularity == "month" else spark.table(name)
    row = counts.select(F.date_format("period_start", "yyyy-MM-dd").alias("d"), "problem_count").collect()
    assert [tuple(r) for r in row] == [(first, 2)]


def test_months_add_up_days_whose_state_is_evicted(spark, tmp_path):
    days = ["2025-01-01", "2025-01-31", "2025-01-31", "2025-02-01", "2025-03-20"]
    spark.createDataFrame([(f"{day} 10:00:00",) for day in days], "t string").select(F.to_timestamp("t").alias("ts")).write.parquet(f"{tmp_path}/land")
    counted = volume.problem_volume(spark.readStream.schema("ts timestamp").parquet(f"{tmp_path}/land"), "month")
    query = counted.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    # The last day waits for the watermark to pass it; all others are written and gone from the state.
    found = volume.monthly(spark.read.parquet(f"{tmp_path}/out")).select(F.date_format("period_start", "yyyy-MM-dd").alias("d"), "problem_count")
    assert {tuple(r) for r in found.collect()} == {("2025-01-01", 3), ("2025-02-01", 1)}
    assert query.lastProgress.stateOperators[0].numRowsTotal == 1


def test_late_rows_are_counted(spark, tmp_path):
    land = tmp_path / "land"
    listener = volume.LateRows()
    spark.streams.addListener(listener)
    try:
        for nth, day in enumerate(["2024-03-01", "2024-03-20", "2024-01-05"]):
            spark.createDataFrame([(f"{day} 10:00:00",)], "t string").select(F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(land))
            counted = volume.problem_volume(spark.readStream.schema("ts timestamp").parquet(str(land)), "day")
            query = counted.writeStream.outputMode("append").format("noop").option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
            query.awaitTermination()
            name = str(query.id)
            deadline = time.time() + 30
            while name not in listener.ended and time.time() < deadline:
                time.sleep(0.1)
            listener.ended.discard(name)
        assert listener.dropped[name] == 1
    finally:
        spark.streams.removeListener(listener)


def test_ids_are_in_every_batch_of_a_stream(spark, tmp_path):
    land, table, progress = (str(tmp_path / n) for n in ("land", "table", "progress"))
    schema = "source string, external_id string, title string, arrived_at timestamp"
    for batch in (["1", "2", "2"], ["2", "3"]):
        rows = [("s", i, "t") for i in batch]
        spark.createDataFrame(rows, "source string, external_id string, title string").withColumn("arrived_at", F.current_timestamp()).write.mode("append").parquet(land)
        stream_ingest.ingest_new(spark.readStream.schema(schema).parquet(land), table, progress).awaitTermination()
    stored = spark.read.parquet(table)
    assert sorted(r.external_id for r in stored.collect()) == ["1", "2", "3"]
    assert stored.filter("id IS NULL").isEmpty()


def test_repeated_batch_order_keeps_rows_apart(spark):
    size = 4
    raw = raw_items(spark, [("1", "I wish there was a tool"), ("2", "Release notes for version 2")]).withColumn("batch_order", F.lit(7))
    encoder = lambda df: df.select("*", F.array(*[F.lit(0.5)] * size).cast("array<float>").alias("embedding"), F.lit("m").alias("embedding_model"))
    batch = ingest.ingest(spark.createDataFrame([], SOURCE_ITEMS), raw, classify.classify_lexically, encoder, size)
    assert batch.classified.count() == 2
    assert {r.external_id: (r.is_problem, r.embedding is not None) for r in batch.table.collect()} == {"1": (True, True), "2": (False, False)}


@pytest.mark.parametrize("folder", [False, True])
def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path, folder):
    def write(name, rows, schema):
        df = spark.createDataFrame(rows, schema)
        df.repartition(3 if folder else 1).write.parquet(f"{tmp_path}/{name}.parquet" if folder else f"{tmp_path}/as-{name}")
        if not folder:
            next((tmp_path / f"as-{name}").glob("part-*.parquet")).rename(tmp_path / f"{name}.parquet")

    write("documents", [(i, f"text {i}", "en", "s", 6) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    write("labels", [(i, i % 2, 0) for i in range(4)], "doc_id long, quality int, toxic int")
    write("embeddings", [(0, [0.5], 0)], "vec_id long, embedding array<float>, label int")
    write("events", [("2025-01-01 08:00:00", "error"), ("2025-01-01 09:00:00", "error"), ("2025-01-02 09:00:00", "view")], "ts string, event_type string")
    got = queries.REGISTRY["stream_insert_new"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == [("s", str(i)) for i in range(4, 9)]
    assert [tuple(r) for r in queries.REGISTRY["stream_daily_problems"](spark, str(tmp_path)).collect()] == [("2025-01-01 00:00:00", 2)]
