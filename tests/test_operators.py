"""Matching, trends, ranking, aggregates, item table, topics, quality, search."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnflow.operators import (
    aggregates,
    approximate,
    blocks,
    classify,
    encode,
    filters,
    items,
    matching,
    quality,
    ranking,
    search,
    topics,
    trends,
)


def centroid_table(spark, clusters):
    rows = [(i, [float(x) for x in v]) for i, v in clusters.items()]
    return spark.createDataFrame(rows, "cluster_id long, centroid array<double>")


def greedy(current, previous, threshold):
    unit = lambda v: np.asarray(v, float) / np.linalg.norm(v)
    pairs = [
        (-round(float(unit(c) @ unit(p)), 12), i, j) for i, c in current.items() for j, p in previous.items()
    ]
    used, found = set(), {}
    for s, i, j in sorted(p for p in pairs if -p[0] >= threshold):
        if i not in found and j not in used:
            found[i] = j
            used.add(j)
    return found


def matched(spark, current, previous, *args):
    rows = matching.match_pairs(centroid_table(spark, current), centroid_table(spark, previous), *args).collect()
    return {r.current: r.previous for r in rows}


def test_matching_golden_cases(spark):
    assert matched(spark, {100: [1, 0], 101: [0, 1]}, {10: [0, 2], 20: [0.8, 0.6]}, 0.8) == {100: 20, 101: 10}
    # equal similarity goes to the lower previous id
    assert matched(spark, {1: [1, 0]}, {30: [1, 0], 20: [2, 0]}, 0.8) == {1: 20}
    assert matched(spark, {1: [1, 0]}, {5: [0, 1]}, 0.8) == {}


def test_matching_equals_greedy_with_short_lists_and_small_blocks(spark):
    rng = np.random.default_rng(1)
    current = {i: rng.normal(size=3) for i in range(40)}
    previous = {1000 + i: rng.normal(size=3) for i in range(30)}
    for i in range(4):
        current[i] = previous[1000 + i] = np.ones(3)
    assert matched(spark, current, previous, 0.3, 3, 12) == greedy(current, previous, 0.3)


def test_matching_in_parts_and_in_rounds_equals_greedy(spark):
    rng = np.random.default_rng(3)
    # Small angles between neighbours of one fan, none between fans: parts of the candidate graph, with exact ties.
    fans = {f: rng.normal(size=4) for f in range(6)}
    turn = lambda f, step: fans[f] / np.linalg.norm(fans[f]) + 0.01 * step * np.eye(4)[f % 4]
    current = {i: turn(i % 6, i // 6) for i in range(42)}
    previous = {1000 + i: turn(i % 6, (i // 6) // 2 * 2) for i in range(36)}
    want = greedy(current, previous, 0.98)
    for group_rows in (500_000, 40, 1):
        assert matched(spark, current, previous, 0.98, 3, 4096, group_rows) == want


def test_matching_of_many_identical_centroids(spark):
    rng = np.random.default_rng(7)
    current = {i: np.array([1.0, 1.0, 0.0]) for i in range(30)} | {i: rng.normal(size=3) for i in range(30, 36)}
    previous = {1000 + i: np.array([1.0, 1.0, 0.05]) for i in range(24)} | {1030 + i: rng.normal(size=3) for i in range(5)}
    assert matched(spark, current, previous, 0.3, 8) == greedy(current, previous, 0.3)


def test_zero_centroid_is_rejected(spark):
    with pytest.raises(Exception, match="zero vector"):
        matched(spark, {1: [0, 0]}, {2: [1, 0]}, 0.8)
    with pytest.raises(ValueError):
        matching.validate_threshold(1.5)


def test_nearest_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base, asked = rng.integers(0, 4, size=(150, 3)).astype(float), rng.normal(size=(40, 3)) * 2
    table = lambda v: spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vector array<double>")
    got = blocks.nearest_neighbours(table(asked), table(base), 5, block_rows=20).collect()
    by_query = {}
    for r in sorted(got, key=lambda r: (r.id, r.position)):
        by_query.setdefault(r.id, []).append(r.neighbour)
    gaps = np.round(np.sqrt(((asked[:, None] - base[None]) ** 2).sum(2)), 12)
    want = {i: [int(j) for j in np.lexsort((np.arange(150), gaps[i]))[:5]] for i in range(40)}
    assert by_query == want


def test_approximate_search_has_most_true_neighbours_and_falls_back(spark):
    rng = np.random.default_rng(12)
    table = [(i, True, [float(x) for x in v], "m") for i, v in enumerate(rng.normal(size=(900, 16)))]
    items = spark.createDataFrame(table, "id long, is_problem boolean, embedding array<float>, embedding_model string")
    queries = items.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = search.search_many(queries, items, 5, "m", 100)
    found = approximate.search_approximately(queries, items, 5, "m", probes=6, rerank=12, block_rows=100, sample=300)
    measured = approximate.recall(found, exact).head()
    assert (measured.queries, measured.neighbours) == (900, 4500) and 0.9 <= measured.recall
    one = approximate.search_approximately(queries, items, 5, "m", probes=1, rerank=1, block_rows=10, sample=300)
    assert one.groupBy("query_id").count().filter("count = 5").count() == 900
    few = items.limit(3)
    assert approximate.search_approximately(queries, few, 5, "m").count() == 2700
    assert approximate.search_approximately(queries, items.limit(0), 5, "m").collect() == []


def ranking_inputs(spark):
    clusters = spark.createDataFrame(
        [(1, "a", ["a"], 10, 2, 0.5), (2, "b", ["b"], 20, 1, 0.5), (3, "c", ["c"], 10, 2, 0.5), (4, "d", ["d"], 5, 1, 1.0)],
        "cluster_id long, label string, keywords array<string>, document_count long, source_count long, average_problem_confidence double",
    )
    trend = spark.createDataFrame(
        [(1, 0.5, "rising"), (2, -0.5, "falling"), (3, 0.5, "rising"), (4, None, "new")],
        "current_cluster_id long, growth_rate double, status string",
    )
    return clusters, trend


def test_ranking_scores_and_ties(spark):
    clusters, trend = ranking_inputs(spark)
    rows = ranking.rank_opportunities(clusters, trend).orderBy("rank").collect()
    assert [r.cluster_id for r in rows] == [1, 3, 4, 2]
    assert rows[0].opportunity_score == pytest.approx(0.35 * 0.5 + 0.35 + 0.15 + 0.15 * 0.5)
    again = ranking.rank_opportunities(clusters.orderBy(F.desc("cluster_id")).repartition(3), trend.repartition(2))
    assert again.orderBy("rank").collect() == rows


def test_ranking_many_runs_at_once(spark):
    clusters, trend = ranking_inputs(spark)
    runs = spark.createDataFrame([(7,), (8,)], "run_id long")
    both = lambda df: df.join(runs)
    rows = ranking.rank_opportunities(both(clusters), both(trend), by=["run_id"]).collect()
    assert sorted((r.run_id, r["rank"], r.cluster_id) for r in rows) == [
        (run, n, c) for run in (7, 8) for n, c in enumerate([1, 3, 4, 2], 1)
    ]


def test_global_rank_over_many_partitions(spark):
    values = list(range(500))
    random.Random(3).shuffle(values)
    df = spark.createDataFrame([(v, v % 3) for v in values], "v int, g int").repartition(7)
    with_parts = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in with_parts.items():
        spark.conf.set(k, v)
    try:
        rows = ranking.global_rank(df, [F.col("g"), F.col("v")]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {v: n for n, (_, v) in enumerate(sorted((v % 3, v) for v in range(500)), 1)}
    assert {r.v: r["rank"] for r in rows} == want


@pytest.mark.parametrize("weights", [{"volume": 1.0}, dict(ranking.WEIGHTS, volume=0.4), dict(ranking.WEIGHTS, volume=-0.35, growth=1.05)])
def test_bad_weights(weights):
    with pytest.raises(ValueError):
        ranking.validate_weights(weights)


def test_trends_cover_new_and_matched(spark):
    current = spark.createDataFrame([(1, "a", 15), (2, "b", 7), (3, "c", 4)], "cluster_id long, label string, document_count long")
    previous = spark.createDataFrame([(9, "x", 10), (8, "y", 10)], "cluster_id long, label string, document_count long")
    matches = spark.createDataFrame(
        [(1, 9, 0.9, "matched"), (2, 8, 0.85, "matched"), (3, None, 0.0, "new")],
        "current_cluster_id long, previous_cluster_id long, similarity double, status string",
    )
    rows = {r.current_cluster_id: r for r in trends.detect_trends(current, previous, matches).collect()}
    assert (rows[1].status, rows[1].growth_rate, rows[1].absolute_change) == ("rising", 0.5, 5)
    assert (rows[2].status, rows[2].growth_rate) == ("falling", -0.3)
    assert (rows[3].status, rows[3].growth_rate, rows[3].previous_count, rows[3].similarity) == ("new", None, 0, None)
    assert quality.match_violations(matches, current, previous).isEmpty()
    assert quality.trend_violations(trends.detect_trends(current, previous, matches), current, previous).isEmpty()


def test_breakdown_sums_to_one(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 0)], "source string, problem_count long")
    rows = aggregates.source_breakdown(counts).collect()
    assert [r.source for r in rows] == ["a", "b", "c"]
    assert sum(r.percentage for r in rows) == pytest.approx(1.0, abs=1e-15)
    assert aggregates.source_breakdown(counts.limit(0)).isEmpty()


def test_summary_of_nothing_is_a_zero_row(spark):
    none = spark.createDataFrame([], "source string, problem_count long")
    clusters = spark.createDataFrame([], "cluster_id long")
    trend = spark.createDataFrame([], "status string")
    runs = spark.createDataFrame([], "id long, created_at timestamp")
    row = aggregates.dashboard_summary(aggregates.source_breakdown(none), clusters, trend, runs).head()
    assert (row.total_problems, row.total_clusters, row.new_clusters, row.latest_run_id) == (0, 0, 0, None)


def test_evaluation_of_nothing_is_zero(spark):
    row = aggregates.confusion(spark.createDataFrame([], "expected boolean, predicted boolean")).head()
    assert (row.accuracy, row.precision, row.recall, row.f1_score) == (0, 0, 0, 0)


def test_cluster_page_puts_missing_growth_last_and_keeps_ties_in_id_order(spark):
    df = spark.createDataFrame([(1, None, 1), (2, 0.5, 1), (3, 0.5, 1), (4, -1.0, 1)], "cluster_id long, growth_rate double, document_count long")
    ids = lambda order: [r.cluster_id for r in filters.cluster_page(df, 10, 0, "growth_rate", order).collect()]
    assert ids("desc") == [2, 3, 4, 1]
    assert ids("asc") == [1, 4, 2, 3]
    for bad in (dict(limit=0), dict(limit=101), dict(offset=-1), dict(sort_by="label"), dict(order="up")):
        with pytest.raises(ValueError):
            filters.cluster_page(df, **bad)


def test_topic_labels_golden(spark):
    texts = ["Cloud deployment automation", "cloud automation for deployment", "the cloud and its automation"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "cluster_id long, item_id long, document_text string")
    row = topics.label_clusters(df, 3).head()
    assert row.keywords == ["automation", "cloud", "deployment"] and row.label == "automation, cloud, deployment"
    blank = spark.createDataFrame([(1, 1, "the and of"), (2, 2, " "), (2, 3, "words")], df.schema)
    got = {r.cluster_id: r.reason for r in topics.unlabelled(blank, topics.label_clusters(blank)).collect()}
    assert got == {1: "no keywords", 2: "empty text"}




def raw(spark, rows):
    base = spark.createDataFrame(rows, "external_id string, title string, batch_order long, is_problem boolean, embedding array<float>")
    return items.prepare(
        base.withColumns(
            {
                "source": F.lit("s"),
                "body": F.lit("body"),
                "url": F.lit("u"),
                "author": F.lit(None).cast("string"),
                "published_at": F.timestamp_seconds(F.lit(0)),
                "engagement_score": F.lit(1),
                "raw_payload": F.lit("{}"),
                "problem_confidence": F.when(F.col("is_problem").isNotNull(), 0.5),
                "problem_reason": F.when(F.col("is_problem").isNotNull(), "r"),
                "problem_classifier": F.when(F.col("is_problem").isNotNull(), "c"),
                "embedding_model": F.when(F.col("embedding").isNotNull(), "m"),
            }
        )
    )


def empty_table(spark):
    from cairnflow.schemas import SOURCE_ITEMS

    return spark.createDataFrame([], SOURCE_ITEMS)


def test_upsert_keeps_clears_and_replaces(spark):
    one = items.upsert(empty_table(spark), raw(spark, [("a", "A", 0, True, [1.0]), ("b", "B", 0, True, [2.0]), ("c", "C", 0, None, None)]))
    two = items.upsert(one, raw(spark, [("a", "A2", 0, None, None), ("b", "B2", 0, False, None), ("d", "D", 0, True, [4.0])]))
    rows = {r.external_id: r for r in two.collect()}
    assert len(rows) == 4 and len({r.id for r in rows.values()}) == 4
    assert (rows["a"].title, rows["a"].is_problem, rows["a"].embedding) == ("A2", True, [1.0])
    assert (rows["b"].is_problem, rows["b"].embedding, rows["b"].embedding_model) == (False, None, None)
    assert (rows["c"].is_problem, rows["c"].title) == (None, "C")
    assert quality.item_violations(two).isEmpty()


def test_upsert_folds_a_batch_in_order(spark):
    batch = raw(
        spark,
        [("a", "1", 1, True, [1.0]), ("a", "2", 2, False, None), ("a", "3", 3, None, None), ("b", "1", 1, False, None), ("b", "2", 2, True, [2.0])],
    )
    rows = {r.external_id: r for r in items.upsert(empty_table(spark), batch.repartition(3)).collect()}
    assert (rows["a"].title, rows["a"].is_problem, rows["a"].embedding) == ("3", False, None)
    assert (rows["b"].is_problem, rows["b"].embedding) == (True, [2.0])


def test_vectors_of_non_problems_are_rejected(spark):
    batch = raw(spark, [("a", "A", 0, False, [1.0]), ("b", "B", 0, None, [1.0]), ("c", "C", 0, True, [1.0, 2.0]), ("d", "D", 0, True, [1.0])])
    got = {r.external_id: r.reason for r in items.rejected_vectors(empty_table(spark), batch, 1).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"] == got["b"] == "embedding requires a problem"


def test_scorer_plugin_treats_malformed_output_as_non_problem(spark):
    df = spark.createDataFrame([("s", str(i), f"text {i}" if i else " ") for i in range(100)], "source string, external_id string, document_text string")

    def scorer(batches):
        for batch in batches:
            bad = batch["document_text"] == "text 7"
            batch["output"] = '{"is_problem": true, "confidence": 0.9, "reason": "r"}'
            batch.loc[bad, "output"] = "no json"
            yield batch[["row_id", "output"]]

    rows = {r.external_id: r for r in classify.classify(df, scorer, "fake").collect()}
    assert len(rows) == 100 and sum(r.malformed for r in rows.values()) == 1
    assert rows["0"].is_problem is None and rows["0"].problem_classifier is None
    assert (rows["7"].is_problem, rows["7"].problem_confidence) == (False, 0.0)
    assert rows["8"].problem_classifier == "fake"


def test_repeated_keys_keep_their_own_verdicts(spark):
    texts = ["yes one", "no two", "yes one", " ", "no three"]
    df = spark.createDataFrame([(n, "s", "1", t) for n, t in enumerate(texts)], "n int, source string, external_id string, document_text string")

    def scorer(batches):
        for batch in batches:
            said = batch["document_text"].str.startswith("yes").map({True: "true", False: "false"})
            batch["output"] = '{"is_problem": ' + said + ', "confidence": 0.9, "reason": "' + batch["document_text"] + '"}'
            yield batch[["row_id", "output"]]

    rows = sorted(classify.classify(df, scorer, "fake").collect(), key=lambda r: r.n)
    assert [(r.n, r.is_problem, r.problem_reason) for r in rows] == [
        (0, True, "yes one"), (1, False, "no two"), (2, True, "yes one"), (3, None, None), (4, False, "no three")
    ]


def test_lexical_cues(spark):
    texts = ["I wish there was an app", "Release notes for version 2", "Is there a tool for this tedious manual work?"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, document_text string")
    assert [r.is_problem for r in classify.classify_lexically(df).orderBy("id").collect()] == [True, False, True]


def test_encoders(spark):
    df = spark.createDataFrame([(1, "alpha beta", True), (2, "beta alpha", True), (3, "gamma", True), (4, "x", False), (5, "!?", True)], "id long, document_text string, is_problem boolean")
    rows = {r.id: r.embedding for r in encode.encode_by_hashing(df, 16).collect()}
    assert set(rows) == {1, 2, 3, 5} and rows[1] == rows[2] != rows[3]
    assert all(abs(np.linalg.norm(v) - 1) < 1e-6 for v in rows.values())

    def wrong(batches):
        for batch in batches:
            batch["embedding"] = [[1.0]] * len(batch)
            yield batch[["id", "embedding"]]

    assert encode.encode(df, wrong, "m", 1).count() == 4
    with pytest.raises(Exception, match="finite values"):
        encode.encode(df, wrong, "m", 2).collect()


def test_batch_search_equals_single_search(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(
        [(i, True, [float(x) for x in rng.normal(size=4)], "m") for i in range(60)],
        "id long, is_problem boolean, embedding array<double>, embedding_model string",
    )
    queries = df.filter("id < 5").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    many = search.search_many(queries, df, 4, "m", block_rows=10).collect()
    for row in queries.collect():
        single = [r.id for r in filters.nearest(df, row.vector, 4, "m").collect()]
        assert [r.item_id for r in sorted(many, key=lambda r: r.position) if r.query_id == row.query_id] == single


def test_centroids_are_plain_means(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [5.0, 5.0])], "cluster_id long, embedding array<float>")
    assert {r.cluster_id: r.centroid for r in aggregates.centroids(df).collect()} == {1: [2.0, 4.0], 2: [5.0, 5.0]}


def test_join_by_weight_with_hot_and_rare_keys(spark):
    from cairnflow.operators.skew import join_by_weight

    left = spark.range(3000).select("id", F.when(F.col("id") < 1000, -1).otherwise(F.col("id")).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("k") != 2999).withColumn("v", F.col("k") * 2)
    got = join_by_weight(left, right, ["k"], "n", "id")
    assert got.columns == ["id", "k", "n", "v"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").select(*got.columns).collect()))
