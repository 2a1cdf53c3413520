"""The registered queries: one per operator, each over whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairnflow import fixtures as X
from cairnflow.catalog import landing
from cairnflow.functions import numbers as N
from cairnflow.functions import text as T
from cairnflow.functions import vectors as V
from cairnflow.operators import (
    aggregates,
    approximate,
    classify,
    cleaning,
    coverage,
    density,
    encode,
    evidence,
    filters,
    items as I,
    matching,
    quality,
    ranking,
    runs,
    search,
    topics,
    trends,
)
from cairnflow.plans import analysis, dashboard, ingest, store
from cairnflow.schemas import SOURCE_ITEMS
from cairnflow.session import prepare, read_or_empty, shared_folder
from cairnflow.sources import combined, github, hackernews, records, reddit, stackexchange, worklists
from cairnflow.streaming import ingest as stream_ingest
from cairnflow.streaming import volume

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
KEY = ["source", "external_id"]


def register(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(prepare(spark), sf_dir)

    REGISTRY[function.__name__] = run
    return run


def flag(condition: Column) -> Column:
    return condition.cast("int")


def stamp(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def r6(name: str) -> Column:
    return F.round(name, 6).alias(name)


# --- sources ----------------------------------------------------------------------------------


def _raw_summary(raw: DataFrame) -> DataFrame:
    return raw.select(
        "external_id",
        "source",
        "title",
        F.md5("body").alias("body_md5"),
        "url",
        F.coalesce("author", F.lit("?")).alias("author"),
        F.unix_timestamp("published_at").alias("published_epoch"),
        F.coalesce("engagement_score", F.lit(-1)).alias("engagement_score"),
    )


@register
def hackernews_items(spark, d):
    return _raw_summary(hackernews.normalize(landing.hackernews(landing.documents(spark, d))))


@register
def hackernews_feed_ids(spark, d):
    return hackernews.feed_ids(landing.id_lists(landing.documents(spark, d)), "page")


def _feed_scan(spark, d, limit=None):
    docs = landing.documents(spark, d)
    payloads = landing.hackernews(docs).select(F.col("doc_id").alias("item_id"), "value")
    each = F.col("doc_id")
    lists = [("topstories", 3, -each), ("newstories", 2, each), ("beststories", 5, each)]
    ids = reduce(
        DataFrame.unionByName,
        [
            docs.filter(F.pmod(each, F.lit(step)) == 0).select(
                F.lit(name).alias("feed"), place.alias("position"), each.alias("item_id")
            )
            for name, step, place in lists
        ],
    )
    found = hackernews.scan_feeds(ids, payloads, limit=limit)
    return found.select("external_id", F.col("seen.feed_order").cast("int").alias("feed_order"), "seen.position")


@register
def hackernews_feed_scan(spark, d):
    return _feed_scan(spark, d)


@register
def hackernews_feed_first(spark, d):
    return _feed_scan(spark, d, 60)


@register
def github_issues(spark, d):
    return _raw_summary(github.normalize(landing.github(landing.documents(spark, d))))


@register
def stackexchange_questions(spark, d):
    return _raw_summary(stackexchange.normalize(landing.stackexchange(landing.documents(spark, d))))


@register
def stackexchange_pages(spark, d):
    """Pages of fifty questions a site; every seventh page says that it is the last one."""
    rows = landing.stackexchange(landing.documents(spark, d)).withColumn("page", (F.floor(F.col("doc_id") / 150) + 1).cast("int"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "value"))), lambda row: row["value"])
    more = F.when(F.pmod("page", F.lit(7)) == 0, "false").otherwise("true")
    answer = F.concat(F.lit('{"items":['), F.array_join(ordered, ","), F.lit('],"has_more":'), F.first(more), F.lit("}"))
    pages = rows.groupBy("site", "page").agg(answer.alias("value"))
    return stackexchange.scan_sites(pages, ["site2", " Site0"]).select("external_id")


def _paged_scan(spark, d, limit=None):
    # Pages of 120 ids, a page counts as full from three issues on.
    pages = landing.github(landing.documents(spark, d)).select(
        "repository", (F.floor(F.col("doc_id") / 120) + 1).alias("page"), F.col("doc_id").alias("position"), "value"
    )
    repositories = ["org/src1", " Org/src0", "org/src2/"]
    return github.scan_repositories(pages, repositories, limit, page_size=3).select("external_id")


@register
def github_paged_scan(spark, d):
    return _paged_scan(spark, d)


@register
def github_paged_first(spark, d):
    return _paged_scan(spark, d, 20)


@register
def reddit_posts(spark, d):
    return _raw_summary(reddit.normalize(landing.reddit(landing.documents(spark, d))))


def _listing_scan(spark, d, limit=None):
    posts = landing.reddit(landing.documents(spark, d)).select(
        F.col("source").alias("subreddit"), F.col("doc_id").alias("position"), F.try_parse_json("value").alias("post")
    )
    found = reddit.scan_listings(posts, ["src2", "r/src0"], limit)
    return found.select("external_id", F.col("seen.turn").alias("turn"), "seen.position")


@register
def reddit_listing_scan(spark, d):
    return _listing_scan(spark, d)


@register
def reddit_listing_first(spark, d):
    return _listing_scan(spark, d, 15)


@register
def multi_source_union(spark, d):
    docs = landing.documents(spark, d)
    items = {
        "hackernews": hackernews.normalize(landing.hackernews(docs)),
        "github": github.normalize(landing.github(docs)),
        "reddit": reddit.normalize(landing.reddit(docs)),
    }
    both = combined.union_sources(items, ["Reddit", " hackernews", "github"])
    return both.groupBy("source", "source_order").agg(F.count("*").alias("n"))


def _classification_rows(spark, d) -> DataFrame:
    lines = landing.classifications(landing.documents(spark, d))
    return records.parse(lines, records.CLASSIFICATION, "doc_id")


@register
def classification_lines(spark, d):
    return _classification_rows(spark, d).select(
        "doc_id",
        F.coalesce("source", F.lit("?")).alias("source"),
        F.coalesce("external_id", F.lit("?")).alias("external_id"),
        F.coalesce(flag(F.col("is_problem")), F.lit(0)).alias("is_problem"),
        F.coalesce("confidence", F.lit(-1.0)).alias("confidence"),
        F.coalesce("rejected", F.lit("ok")).alias("verdict"),
    )


@register
def classification_duplicates(spark, d):
    rows = landing.documents(spark, d).select(
        "source", (F.col("n_chars") >= 400).alias("long"), F.pmod("n_chars", F.lit(2)).alias("odd")
    )
    return records.repeated_keys(rows, "source")


@register
def model_outputs(spark, d):
    parsed = records.parse_model_output(landing.model_answers(landing.documents(spark, d)), "output", "doc_id")
    return parsed.select(
        "doc_id",
        flag(F.col("malformed")).alias("malformed"),
        F.coalesce(flag(F.col("is_problem")), F.lit(0)).alias("is_problem"),
        F.coalesce("confidence", F.lit(-1.0)).alias("confidence"),
        F.coalesce("reason", F.lit("?")).alias("reason"),
    )


@register
def work_items(spark, d):
    m = landing.defect(5)
    line = landing.record(
        F.when(m == 1, landing.member('"source":" "')).otherwise(landing.field("source", F.col("source"))),
        landing.field("external_id", F.col("doc_id").cast("string")),
        F.when(m != 0, landing.field("document_text", F.col("text"))),
    )
    lines = landing.documents(spark, d).select("doc_id", line.alias("value"))
    parsed = records.parse(lines, records.WORK_ITEM, "doc_id")
    return parsed.select("doc_id", F.coalesce("rejected", F.lit("ok")).alias("verdict"))


@register
def evaluation_cases(spark, d):
    m = landing.defect(5)
    line = landing.record(
        landing.field("id", F.col("doc_id").cast("string")),
        landing.field("text", F.col("text")),
        F.when(m == 0, landing.member('"expected_is_problem":"yes"')).otherwise(
            landing.field("expected_is_problem", F.col("n_chars") >= 400)
        ),
        landing.field("category", F.col("source")),
    )
    lines = landing.documents(spark, d).select("doc_id", line.alias("value"))
    parsed = records.parse(lines, records.EVALUATION_CASE, "doc_id")
    return parsed.select("doc_id", F.coalesce("rejected", F.lit("ok")).alias("verdict"))


@register
def export_unclassified(spark, d):
    return worklists.unclassified(X.source_items(spark, d)).select(*KEY, F.md5("document_text").alias("text_md5"))


@register
def pending_work(spark, d):
    items = X.source_items(spark, d)
    work = worklists.unclassified(items)
    return worklists.pending(work, items.filter(F.pmod("id", F.lit(3)) == 0)).select(*KEY)


@register
def lookup_by_key(spark, d):
    items = X.source_items(spark, d)
    return worklists.lookup(items, items.filter("is_problem")).select("id", "url")


@register
def lookup_by_hash(spark, d):
    hashed = X.source_items(spark, d).select(
        "id", "is_problem", T.text_hash(F.col("document_text")).alias("dedup_hash")
    )
    return worklists.lookup_hash(hashed, hashed.filter("is_problem")).select("id", "dedup_hash")


@register
def known_keys(spark, d):
    items = X.source_items(spark, d)
    found = worklists.known(items.filter(F.col("is_problem").isNotNull()), items.select(*KEY))
    return found.select("external_id", flag(F.col("known")).alias("known"))


# --- filters, projections, scalars ------------------------------------------------------------


@register
def problem_filter(spark, d):
    return filters.problems(X.source_items(spark, d)).select("id", "source")


@register
def vector_space(spark, d):
    total = F.aggregate(V.as_double(F.col("embedding")), F.lit(0.0), lambda s, x: s + x)
    return filters.vector_space(X.source_items(spark, d), X.MODEL).select("id", F.round(total, 6).alias("total"))


@register
def run_members(spark, d):
    items = X.source_items(spark, d)
    stored = [
        rows.select("cluster_id", "item_id", F.lit(run).alias("run_id"))
        for rows, run in ((X.current_members(items), X.CURRENT_RUN), (X.previous_members(items), X.PREVIOUS_RUN))
    ]
    return filters.of_run(stored[0].unionByName(stored[1]), X.CURRENT_RUN, 105).select("cluster_id", "item_id")


@register
def cluster_set(spark, d):
    """Members of given labels; label 9 stands for noise."""
    labels = X.current_members(X.source_items(spark, d)).select(
        F.when(F.col("cluster_id") == 109, -1).otherwise(F.col("cluster_id")).alias("cluster_id"), "item_id"
    )
    return filters.without_noise(labels).orderBy("cluster_id", "item_id")


@register
def pending_embedding(spark, d):
    return filters.pending_embedding(X.source_items(spark, d)).select("id")


@register
def public_documents(spark, d):
    return filters.public_documents(X.source_items(spark, d)).select("id", "title", "url", "problem_confidence")


@register
def clean_text(spark, d):
    return X.table(spark, d, "pages").select("page_id", T.clean_text(F.col("html")).alias("cleaned"))


@register
def document_text_and_hash(spark, d):
    raw = landing.documents(spark, d).select("doc_id", "title", F.col("text").alias("body"))
    return I.prepare(raw).select("doc_id", F.md5("document_text").alias("text_md5"), "dedup_hash")


@register
def excerpt(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@register
def words(spark, d):
    found = X.table(spark, d, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    return found.select(
        "doc_id",
        F.size("w").cast("long").alias("words"),
        F.size(F.array_distinct("w")).cast("long").alias("distinct_words"),
    )


@register
def period_starts(spark, d):
    starts = [stamp(N.period_start(F.col("ts"), g)).alias(g) for g in ("day", "week", "month")]
    return X.event_stream(spark, d).groupBy(*starts).agg(F.count("*").alias("n"))


@register
def iso_timestamps(spark, d):
    m = landing.defect(4)
    zone = F.when(m == 0, "").when(m == 1, "Z").when(m == 2, "+02:00").otherwise("+00:00")
    moment = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))
    text = F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), zone)
    epoch = F.unix_timestamp(N.iso_timestamp(text))
    return landing.documents(spark, d).select("doc_id", F.coalesce(epoch, F.lit(-1)).alias("epoch"))


@register
def vector_functions(spark, d):
    vectors = X.table(spark, d, "embeddings").select("vec_id", "embedding")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return vectors.join(following, "vec_id").select(
        "vec_id",
        F.round(V.norm(F.col("embedding")), 6).alias("norm"),
        F.round(V.cosine_similarity(F.col("embedding"), F.col("other")), 6).alias("similarity"),
        flag(V.is_valid_vector(F.col("embedding"), X.VECTOR_SIZE)).alias("valid"),
    )


# --- aggregates -------------------------------------------------------------------------------


@register
def problems_per_source(spark, d):
    return aggregates.problems_per_source(X.source_items(spark, d))


@register
def cluster_statistics(spark, d):
    items = X.source_items(spark, d)
    found = aggregates.cluster_statistics(X.current_members(items), items)
    return found.select("cluster_id", "source_count", r6("average_problem_confidence"))


@register
def document_counts(spark, d):
    return aggregates.document_counts(X.current_members(X.source_items(spark, d)))


@register
def source_breakdown(spark, d):
    found = aggregates.source_breakdown(aggregates.problems_per_source(X.source_items(spark, d)))
    return found.select("source", "problem_count", r6("percentage"))


@register
def centroids(spark, d):
    found = aggregates.centroids(X.current_members(X.source_items(spark, d)))
    values = found.select("cluster_id", F.posexplode("centroid").alias("position", "value"))
    return values.select("cluster_id", (F.col("position") + 1).alias("position"), r6("value"))


@register
def trend_distribution(spark, d):
    return aggregates.trend_distribution(_trends(X.source_items(spark, d)))


def _series(spark, d, granularity: str) -> DataFrame:
    found = aggregates.run_series(X.run_history(spark, d), granularity)
    return found.withColumn("period_start", stamp(F.col("period_start")))


@register
def series_day(spark, d):
    return _series(spark, d, "day")


@register
def series_week(spark, d):
    return _series(spark, d, "week")


@register
def series_month(spark, d):
    return _series(spark, d, "month")


@register
def last_periods(spark, d):
    series = aggregates.run_series(X.run_history(spark, d), "day")
    return filters.last_periods(series, 3).select(stamp(F.col("period_start")).alias("period_start"), "total_problems")


@register
def classifier_evaluation(spark, d):
    found = aggregates.confusion(X.predictions(spark, d))
    rates = ("accuracy", "precision", "recall", "f1_score")
    return found.select(*[c for c in found.columns if c not in rates], *[r6(c) for c in rates])


@register
def misclassified(spark, d):
    return aggregates.misclassified(X.predictions(spark, d)).select("doc_id", flag(F.col("expected")).alias("expected"))


@register
def ingestion_statistics(spark, d):
    items = X.source_items(spark, d).withColumn("malformed", F.pmod("id", F.lit(10)) == 0)
    found = aggregates.ingestion_statistics(items)
    return found.withColumn("source", F.coalesce("source", F.lit("total")))


@register
def insertion_statistics(spark, d):
    items = X.source_items(spark, d)
    found = aggregates.insertion_statistics(items, items.filter(F.col("is_problem").isNotNull()))
    return found.withColumn("source", F.coalesce("source", F.lit("total")))


@register
def analysis_summary(spark, d):
    items = X.source_items(spark, d)
    assigned = X.current_members(items).filter(F.pmod("item_id", F.lit(5)) > 0)
    return aggregates.analysis_summary(items, assigned, _trends(X.source_items(spark, d)))


@register
def import_report(spark, d):
    rows = _classification_rows(spark, d).filter(F.col("rejected").isNull())
    external = F.when(F.pmod("doc_id", F.lit(3)) == 0, "none").otherwise(F.col("external_id"))
    outcomes = I.import_outcomes(X.source_items(spark, d), rows.withColumn("external_id", external))
    return I.import_report(outcomes)


# --- runs, matching, trends, ranking ----------------------------------------------------------


def _runs(spark, d) -> DataFrame:
    """The run history with parameters that make every third run compatible; NULL is one of them."""
    m = F.pmod("id", F.lit(3))
    return X.run_history(spark, d).withColumns(
        {
            "embedding_model": F.lit(X.MODEL),
            "min_cluster_size": F.lit(2),
            "min_samples": F.when(m == 1, 5).when(m == 2, 7),
            "metric": F.lit("euclidean"),
        }
    )


@register
def latest_run(spark, d):
    return runs.latest_run(_runs(spark, d)).select("id", stamp(F.col("created_at")).alias("created_at"))


@register
def latest_compatible_run(spark, d):
    history = _runs(spark, d)
    metadata = {"embedding_model": X.MODEL, "min_cluster_size": 2, "min_samples": 5, "metric": "euclidean"}
    newest = runs.latest_compatible_run(history, metadata).head()
    found = runs.latest_compatible_run(history, metadata, excluding=newest and newest["id"])
    return found.select("id", stamp(F.col("created_at")).alias("created_at"))


@register
def run_predecessors(spark, d):
    found = runs.predecessors(_runs(spark, d))
    return found.select("id", F.coalesce("previous_id", F.lit(-1)).alias("previous_id"))


def _clusters(members: DataFrame) -> DataFrame:
    label = F.concat(F.lit("cluster "), F.col("cluster_id"))
    return aggregates.document_counts(members).select(
        "cluster_id", label.alias("label"), F.array(label).alias("keywords"), "document_count"
    )


def _matches(items: DataFrame) -> DataFrame:
    current, previous = X.current_members(items), X.previous_members(items)
    return matching.match_clusters(
        aggregates.centroids(current), aggregates.centroids(previous), X.MATCH_THRESHOLD
    )


def _trends(items: DataFrame) -> DataFrame:
    current, previous = X.current_members(items), X.previous_members(items)
    return trends.detect_trends(_clusters(current), _clusters(previous), _matches(items))


def snapshot(spark, d) -> dashboard.Snapshot:
    items = X.source_items(spark, d)
    members = X.current_members(items)
    history = X.run_history(spark, d)
    return dashboard.Snapshot(items, _clusters(members), members, _trends(items), history, history)


@register
def cluster_matching(spark, d):
    return _matches(X.source_items(spark, d)).select(
        "current_cluster_id",
        F.coalesce("previous_cluster_id", F.lit(-1)).alias("previous_cluster_id"),
        r6("similarity"),
        "status",
    )


@register
def trend_detection(spark, d):
    return _trends(X.source_items(spark, d)).select(
        "current_cluster_id",
        F.coalesce("previous_cluster_id", F.lit(-1)).alias("previous_cluster_id"),
        "current_count",
        "previous_count",
        "absolute_change",
        F.coalesce(F.round("growth_rate", 6), F.lit(-999.0)).alias("growth_rate"),
        "status",
        F.coalesce(F.round("similarity", 6), F.lit(-999.0)).alias("similarity"),
    )


def _rank_columns(ranked: DataFrame, *more: Column) -> DataFrame:
    return ranked.select(
        "cluster_id",
        "label",
        "rank",
        r6("opportunity_score"),
        "document_count",
        F.coalesce(F.round("growth_rate", 6), F.lit(-999.0)).alias("growth_rate"),
        "status",
        "source_count",
        r6("average_problem_confidence"),
        *more,
    )


@register
def opportunity_ranking(spark, d):
    parts = ("volume_score", "growth_score", "source_diversity_score")
    more = [F.round(f"score_components.{p}", 6).alias(p) for p in parts]
    return _rank_columns(dashboard.ranked_clusters(snapshot(spark, d)), *more)


def _cluster_texts(spark, d) -> DataFrame:
    items = X.source_items(spark, d)
    texts = items.select(F.col("id").alias("item_id"), "document_text")
    return X.current_members(items).select("cluster_id", "item_id").join(texts, "item_id")


@register
def topic_keywords(spark, d):
    return topics.keywords(_cluster_texts(spark, d)).select("cluster_id", "position", "term", r6("score"))


@register
def topic_labels(spark, d):
    return topics.label_clusters(_cluster_texts(spark, d)).select("cluster_id", "label")


@register
def market_coverage(spark, d):
    return coverage.market_coverage(_clusters(X.current_members(X.source_items(spark, d))), X.solutions(spark, d))


@register
def lexical_classification(spark, d):
    found = classify.classify_lexically(X.source_items(spark, d))
    return found.select("id", flag(F.col("is_problem")).alias("is_problem"), F.col("problem_confidence").alias("confidence"))


@register
def linear_classification(spark, d):
    items = X.source_items(spark, d)
    labelled = items.filter(F.col("is_problem").isNotNull()).select("document_text", F.col("is_problem").alias("expected"))
    scored = classify.classify_linearly(items, classify.train_linear(labelled))
    return scored.select("id", "is_problem", r6("problem_confidence"))


@register
def word_count_classification(spark, d):
    items = X.source_items(spark, d)
    labelled = items.filter(F.col("is_problem").isNotNull()).select("document_text", F.col("is_problem").alias("expected"))
    scored = classify.classify_by_counts(items, labelled)
    return scored.select("id", flag(F.col("is_problem")).alias("is_problem"), F.round("problem_confidence", 6).alias("confidence"))


@register
def document_weights(spark, d):
    weights = encode.document_weights(X.source_items(spark, d))
    return weights.groupBy("id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("largest"))


@register
def projected_vectors(spark, d):
    """Dimensions and length of every projected vector, and whether all have an item."""
    items = X.source_items(spark, d)
    found = encode.encode_by_projection(items, 128)
    return found.select("id", F.size("embedding").alias("dimensions"), F.round(V.norm(F.col("embedding")), 5).alias("norm"), "embedding_model")


@register
def cleaned_documents(spark, d):
    found = cleaning.clean_documents(X.table(spark, d, "documents"), min_length=200, share=0.01)
    return found.select("doc_id", F.sha2("clean_text", 256).alias("digest"), "removed_lines", F.coalesce("reason", F.lit("")).alias("reason"))


@register
def nearest_problems(spark, d):
    first = X.table(spark, d, "embeddings").orderBy("vec_id").select("embedding").head()
    found = search.search_one(X.source_items(spark, d), list(first["embedding"]), 20, X.MODEL)
    return found.select("id", r6("distance"))


@register
def batch_search(spark, d):
    queries = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = search.search_many(queries, X.source_items(spark, d), 5, X.MODEL)
    return found.select("query_id", "item_id", "position", r6("distance"))


@register
def approximate_search(spark, d):
    """Every vector asks for its ten nearest problems; the answers are held against the exact search over all rows."""
    queries = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    items = X.source_items(spark, d)
    found = approximate.search_approximately(queries, items, 10, X.MODEL)
    measured = approximate.recall(found, search.search_many(queries, items, 10, X.MODEL))
    return measured.select("queries", "neighbours", flag(F.col("recall") >= 0.9).alias("recall_is_high"))


@register
def hashing_encoder(spark, d):
    encoded = encode.encode_by_hashing(X.source_items(spark, d))
    return encoded.select(
        "id", F.size("embedding").alias("dimensions"), F.round(V.norm(F.col("embedding")), 6).alias("norm"), "embedding_model"
    )


@register
def density_clustering(spark, d):
    vectors = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return density.density_clusters(vectors, min_cluster_size=5)


@register
def membership_probability(spark, d):
    """Every vector with its cluster and how firmly it belongs to it."""
    vectors = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return density.memberships(vectors, min_cluster_size=5).withColumn("probability", F.round("probability", 6))


# --- item table -------------------------------------------------------------------------------


def _stored(items: DataFrame) -> DataFrame:
    """Fixture items in the full table layout."""
    judged = F.col("is_problem").isNotNull()
    when = F.timestamp_seconds(F.lit(1704067200))
    return items.withColumns(
        {
            "raw_payload": F.lit(None).cast("string"),
            "clean_title": F.col("title"),
            "clean_body": F.col("body"),
            "dedup_hash": F.lit(None).cast("string"),
            "problem_reason": F.when(judged, "r"),
            "problem_classifier": F.when(judged, "c"),
            "classified_at": F.when(judged, when),
            "processed_at": when,
            "author": F.lit("old"),
        }
    )


def _arriving(items: DataFrame) -> DataFrame:
    """Two rounds of rows for every third item: a new version without verdict, then one with."""
    verdict = {
        "is_problem": F.pmod("id", F.lit(6)) == 3,
        "problem_confidence": F.lit(0.5),
        "problem_reason": F.lit("again"),
        "problem_classifier": F.lit("c2"),
    }
    arriving = items.filter(F.pmod("id", F.lit(3)) == 0).drop("embedding", "embedding_model")
    first = arriving.withColumns(
        {"author": F.lit("mid"), "batch_order": F.lit(0), **{c: F.lit(None).cast(arriving.schema[c].dataType) for c in verdict}}
    )
    return first.unionByName(arriving.withColumns({"author": F.lit("new"), "batch_order": F.lit(1), **verdict}))


def _upserted(table: DataFrame) -> DataFrame:
    return table.select(
        "external_id",
        "source",
        F.col("author").alias("version"),
        F.coalesce(flag(F.col("is_problem")), F.lit(-1)).alias("is_problem"),
        flag(F.col("embedding").isNotNull()).alias("has_vector"),
    )


@register
def upsert(spark, d):
    items = _stored(X.source_items(spark, d))
    return _upserted(I.upsert(items.filter(F.col("is_problem").isNotNull()), _arriving(items)))


@register
def upsert_batches(spark, d):
    """The same outcome through a table on disk: the first batch fills it, the second rewrites the buckets it touches."""
    items, path = _stored(X.source_items(spark, d)), f"{shared_folder(spark)}/items-{uuid.uuid4().hex}"
    store.apply_batch(path, items.filter(F.col("is_problem").isNotNull()).withColumn("batch_order", F.lit(0)))
    store.apply_batch(path, _arriving(items))
    return _upserted(store.read_items(spark, path))


@register
def insert_new(spark, d):
    items = X.source_items(spark, d)
    twice = items.select(*KEY, "url", F.lit(1).alias("batch_order")).unionByName(
        items.select(*KEY, "url", F.lit(2).alias("batch_order"))
    )
    return I.insert_new(items.filter(F.col("is_problem").isNotNull()), twice).select(*KEY)


@register
def id_clash_ranks(spark, d):
    """Keys that cannot have the id of their hash, for a hash of three digits that many keys share."""
    items = X.source_items(spark, d)
    short = F.substring(F.md5(F.concat_ws(":", *KEY)), 1, 3)
    return I.clash_ranks(items, items.filter(F.col("is_problem").isNotNull()), short)


def _accepted(spark, d) -> DataFrame:
    return records.split(_classification_rows(spark, d))[0].drop("doc_id")


@register
def apply_classifications(spark, d):
    table = I.apply_classifications(_stored(X.source_items(spark, d)), _accepted(spark, d))
    return table.select("external_id", F.coalesce(flag(F.col("is_problem")), F.lit(-1)).alias("is_problem"))


@register
def overwrite_classifications(spark, d):
    table = I.apply_classifications(_stored(X.source_items(spark, d)), _accepted(spark, d), overwrite=True)
    return table.select(
        "external_id",
        F.coalesce(flag(F.col("is_problem")), F.lit(-1)).alias("is_problem"),
        flag(F.col("embedding").isNotNull()).alias("has_vector"),
    )


def _vectors(items: DataFrame) -> DataFrame:
    return items.filter(F.col("raw_vector").isNotNull()).select(
        *KEY, F.col("raw_vector").alias("embedding"), F.lit(X.MODEL).alias("embedding_model")
    )


@register
def attach_embeddings(spark, d):
    items = X.source_items(spark, d)
    bare = items.withColumns(
        {c: F.lit(None).cast(items.schema[c].dataType) for c in ("embedding", "embedding_model")}
    )
    table = I.attach_embeddings(bare, _vectors(items))
    return table.select("id", flag(F.col("embedding").isNotNull()).alias("has_vector"))


@register
def embedding_report(spark, d):
    items = X.source_items(spark, d)
    half = items.withColumn("embedding", F.when(F.pmod("id", F.lit(2)) == 0, F.col("embedding")))
    return I.embedding_report(I.embedding_outcomes(half, _vectors(items)))


@register
def missing_members(spark, d):
    items = X.source_items(spark, d)
    found = I.missing_members(X.current_members(items), items.filter(F.pmod("id", F.lit(4)) != 0))
    return found.select("cluster_id", "item_id")


# --- quality ----------------------------------------------------------------------------------


@register
def item_violations(spark, d):
    m = F.pmod("id", F.lit(9))
    broken = _stored(X.source_items(spark, d)).withColumns(
        {
            "embedding_model": F.when(m == 0, None).when((m == 1) & F.col("embedding").isNotNull(), "  ").otherwise(F.col("embedding_model")),
            "problem_reason": F.when(m != 2, F.col("problem_reason")),
            "problem_confidence": F.when((m == 3) & F.col("is_problem").isNotNull(), 1.5).otherwise(F.col("problem_confidence")),
        }
    )
    return quality.item_violations(broken)


@register
def repeated_keys(spark, d):
    return quality.repeated(X.table(spark, d, "documents"), "source", "lang")


@register
def classification_violations(spark, d):
    results = landing.documents(spark, d).select(
        "doc_id",
        (F.col("n_chars") >= 400).alias("is_problem"),
        F.when(landing.defect(5) == 0, float("nan")).otherwise(0.5).alias("confidence"),
        F.when(landing.defect(7) == 0, " ").otherwise("r").alias("reason"),
        F.lit("c").alias("classifier_name"),
    )
    return quality.classification_violations(results, "doc_id")


@register
def coverage_violations(spark, d):
    clusters = _clusters(X.current_members(X.source_items(spark, d))).select("cluster_id")
    rows = clusters.filter(F.col("cluster_id") != 109).unionByName(clusters.filter(F.col("cluster_id") == 100)).unionByName(
        clusters.filter(F.col("cluster_id") == 100).select(F.lit(7).cast("long").alias("cluster_id"))
    )
    return quality.coverage_violations(rows, clusters, "cluster_id")


@register
def match_violations(spark, d):
    items = X.source_items(spark, d)
    found = _matches(X.source_items(spark, d)).withColumns(
        {
            "similarity": F.when(F.col("current_cluster_id") == 101, 1.5).otherwise(F.col("similarity")),
            "status": F.lit("matched"),
        }
    )
    return quality.match_violations(found, _clusters(X.current_members(items)), _clusters(X.previous_members(items)))


@register
def trend_violations(spark, d):
    items = X.source_items(spark, d)
    status = F.col("status")
    found = _trends(X.source_items(spark, d)).withColumns(
        {
            "status": F.when(status == "falling", "sinking").otherwise(status),
            "current_count": F.col("current_count") + flag(status == "stable"),
        }
    )
    return quality.trend_violations(found, _clusters(X.current_members(items)), _clusters(X.previous_members(items)))


@register
def ranking_violations(spark, d):
    view = snapshot(spark, d)
    ranked = dashboard.ranked_clusters(view)
    renamed = ranked.withColumn("label", F.when(F.col("rank") <= 3, "other").otherwise(F.col("label")))
    return quality.ranking_violations(renamed, view.clusters)


@register
def match_rules(spark, d):
    """Each rule of matching results that ``match_violations`` leaves whole, broken by one cluster."""
    items = X.source_items(spark, d)
    found = _matches(X.source_items(spark, d))
    cluster, previous = F.col("current_cluster_id"), F.col("previous_cluster_id")
    broken = found.withColumns(
        {
            "previous_cluster_id": F.when(cluster == 104, previous + 1000).otherwise(previous),
            "similarity": F.when(cluster != 105, F.col("similarity")),
        }
    )
    stranger = found.where(cluster == 103).withColumns(
        {"current_cluster_id": cluster + 1000, "previous_cluster_id": F.lit(None).cast("long"), "status": F.lit("new")}
    )
    rows = broken.unionByName(broken.where(cluster == 100)).unionByName(stranger)
    return quality.match_violations(rows, _clusters(X.current_members(items)), _clusters(X.previous_members(items)))


@register
def trend_rules(spark, d):
    """Each rule of trends that ``trend_violations`` leaves whole, broken by one cluster."""
    items = X.source_items(spark, d)
    found = _trends(X.source_items(spark, d))
    cluster, previous = F.col("current_cluster_id"), F.col("previous_cluster_id")
    broken = found.where(cluster != 102).withColumns(
        {
            "previous_cluster_id": F.when(cluster == 107, previous + 1000).when(cluster != 100, previous),
            "status": F.when(cluster == 103, "new").otherwise(F.col("status")),
            "similarity": F.when(cluster == 104, 7.0).otherwise(F.col("similarity")),
            "absolute_change": F.col("absolute_change") + flag(cluster == 105),
            "growth_rate": F.when(cluster == 106, float("inf")).otherwise(F.col("growth_rate")),
            "previous_count": F.when(cluster == 108, -1).otherwise(F.col("previous_count")),
        }
    )
    stranger = found.where(cluster == 109).withColumn("current_cluster_id", cluster + 1000)
    rows = broken.unionByName(broken.where(cluster == 101)).unionByName(stranger)
    return quality.trend_violations(rows, _clusters(X.current_members(items)), _clusters(X.previous_members(items)))


@register
def ranking_rules(spark, d):
    """Each rule of rankings that ``ranking_violations`` leaves whole, broken by one cluster."""
    view = snapshot(spark, d)
    ranked = dashboard.ranked_clusters(view)
    cluster = F.col("cluster_id")
    broken = ranked.where(cluster != 101).withColumns(
        {
            "rank": F.when(cluster == 102, -F.col("rank")).otherwise(F.col("rank")),
            "growth_rate": F.when(cluster == 103, float("inf")).otherwise(F.col("growth_rate")),
            "document_count": F.col("document_count") + flag(cluster == 104),
        }
    )
    stranger = ranked.where(cluster == 105).withColumns({"cluster_id": cluster + 1000, "rank": F.col("rank") + 1000})
    rows = broken.unionByName(broken.where(cluster == 100)).unionByName(stranger)
    return quality.ranking_violations(rows, view.clusters)


@register
def history_violations(spark, d):
    history = _runs(spark, d)
    return quality.history_violations(history, runs.latest_run(history))


@register
def membership_violations(spark, d):
    items = X.source_items(spark, d)
    members = X.current_members(items)
    clusters = _clusters(members).withColumn("run_id", F.lit(X.CURRENT_RUN))
    mixed = items.withColumn("embedding_model", F.concat(F.lit("m"), F.pmod("id", F.lit(2))))
    return quality.membership_violations(clusters, members, mixed, X.CURRENT_RUN)


# --- query surface ----------------------------------------------------------------------------


@register
def cluster_detail(spark, d):
    view = snapshot(spark, d)
    found = dashboard.ranked_clusters(view).filter(F.col("cluster_id") == 105)
    return _rank_columns(found)


@register
def top_opportunities(spark, d):
    return _rank_columns(filters.top_opportunities(dashboard.ranked_clusters(snapshot(spark, d)), 3))


@register
def exact_duplicates(spark, d):
    items = X.source_items(spark, d)
    return evidence.duplicates(items, F.sha2("document_text", 256), "same text")


@register
def url_duplicates(spark, d):
    """Four spellings of one address, made from the ids of the pages."""
    page, nth = F.col("page_id"), F.pmod(F.col("page_id"), F.lit(4))
    base = F.concat(F.lit("https://Example.test/p/"), F.floor(page / 4).cast("string"))
    spelled = (
        F.when(nth == 0, F.concat(base, F.lit("/")))
        .when(nth == 1, F.concat(base, F.lit("?utm_source=feed&utm_medium=x")))
        .when(nth == 2, F.concat(F.lit(" HTTPS://EXAMPLE.TEST/p/"), F.floor(page / 4).cast("string"), F.lit("#top")))
        .otherwise(base)
    )
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", spelled.alias("url"))
    return evidence.duplicates(pages, evidence.canonical_url(F.col("url")), "same address", "page_id")


@register
def cluster_citations(spark, d):
    items = X.source_items(spark, d)
    found = evidence.citations(X.current_members(items), items)
    return found.select("cluster_id", stamp(F.col("first_cited")).alias("first_cited"), stamp(F.col("last_cited")).alias("last_cited"))


@register
def cluster_sources(spark, d):
    items = X.source_items(spark, d)
    found = evidence.source_split(X.current_members(items), items)
    return found.select("cluster_id", "source", "documents", r6("share"))


@register
def cluster_representatives(spark, d):
    items = X.source_items(spark, d)
    members = X.current_members(items)
    found = evidence.representatives(members, items, aggregates.centroids(members))
    return found.select("cluster_id", "item_id", F.col("place").cast("long").alias("place"))


@register
def filtered_clusters(spark, d):
    items = X.source_items(spark, d)
    members = X.current_members(items)
    since, until = F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-25").cast("timestamp")
    found = evidence.filtered_clusters(_clusters(members), members, items, ["src0", "src3", "src5"], since, until, 3)
    return found.select("cluster_id", "document_count", "matching")


@register
def clusters_by_coverage(spark, d):
    items = X.source_items(spark, d)
    members = X.current_members(items)
    found = evidence.filtered_clusters(
        _clusters(members), members, items, coverage=["non_presidiato", "parzialmente_coperto"], solutions=X.solutions(spark, d)
    )
    return found.select("cluster_id", "document_count", "matching")


@register
def success_metrics(spark, d):
    items = X.source_items(spark, d)
    found = evidence.success_metrics(items, X.current_members(items), X.solutions(spark, d))
    return found.select("documents", r6("embedding_coverage"), r6("link_coverage"), "clusters", r6("market_coverage"))


@register
def dashboard_summary(spark, d):
    found = dashboard.summary(snapshot(spark, d))
    return found.withColumn("latest_run_created_at", stamp(F.col("latest_run_created_at")))


@register
def opportunities(spark, d):
    return _rank_columns(dashboard.opportunities(snapshot(spark, d), status="rising"))


@register
def cluster_page(spark, d):
    page = dashboard.clusters(snapshot(spark, d), limit=5, offset=2, sort_by="growth_rate")
    return _rank_columns(page)


@register
def dashboard_trends(spark, d):
    items = X.source_items(spark, d)
    view = dashboard.Snapshot(items, None, None, _trends(items), None, X.run_history(spark, d))
    distribution, series = dashboard.trends(view, "week", 2)
    rising = distribution.select("rising_count").scalar()
    return series.select(stamp(F.col("period_start")).alias("period_start"), "total_problems", rising.alias("rising_now"))


@register
def text_search(spark, d):
    """Every text of the test set as a question, encoded like the documents, against every problem."""
    size = X.VECTOR_SIZE
    encoded = encode.encode_by_hashing(X.source_items(spark, d), size)
    asked = X.table(spark, d, "benchmark").select(F.xxhash64("item_id", "text").alias("query_id"), "item_id", "text").distinct()
    questions = asked.select("query_id", encode.hashed_vector(F.col("text"), size).alias("vector"))
    found = search.search_many(questions, encoded, 10, encode.hashing_model_name(size))
    named = found.withColumnRenamed("item_id", "id").join(asked.select("query_id", "item_id"), "query_id")
    return named.select("item_id", "id", "position", r6("distance"))


@register
def cluster_documents(spark, d):
    items = X.source_items(spark, d)
    view = dashboard.Snapshot(items, None, X.current_members(items), None, None, None)
    found = dashboard.cluster_documents(view, 105, 10)
    return found.select("id", stamp(F.col("published_at")).alias("published_at"), "problem_confidence")


# --- whole runs -------------------------------------------------------------------------------


@register
def conditional_pipeline(spark, d):
    """Issues prepared, classified, embedded where they are problems, and upserted into an empty table."""
    raw = github.normalize(landing.github(landing.documents(spark, d)))
    empty = spark.createDataFrame([], SOURCE_ITEMS)
    batch = ingest.ingest(empty, raw, classify.classify_lexically, lambda rows: encode.encode_by_hashing(rows, 64), 64)
    return batch.table.select(
        "external_id", flag(F.col("is_problem")).alias("is_problem"), F.col("problem_confidence").alias("confidence"), flag(F.col("embedding").isNotNull()).alias("has_vector")
    )


@register
def analysis_run(spark, d):
    """A first and a second run over the stored problems: what is summarised, and that trends cover every cluster."""
    items = X.source_items(spark, d)
    runs_of = store.RunStore(spark, f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}")
    parameters = analysis.Parameters(X.MODEL, min_cluster_size=5)
    first, second = analysis.analyse(items, runs_of, parameters), analysis.analyse(items, runs_of, parameters)
    rows = []
    for run in (first, second):
        row = analysis.summary(items, runs_of, run).withColumn("run", F.lit(run))
        clusters = runs_of.clusters(run).agg(F.count("*").alias("clusters"))
        rows.append(row.crossJoin(F.broadcast(clusters)))
    whole = rows[0].unionByName(rows[1])
    # The second run sees the same items: nothing is new and everything stable.
    return whole.select(
        "run", "available", "embedded", flag(F.col("assigned") + F.col("noise") == F.col("embedded")).alias("balanced"),
        flag(F.when(F.col("run") == 1, F.col("new_clusters")).otherwise(F.col("stable_clusters")) == F.col("clusters")).alias("covered"),
    )


@register
def latest_run_analytics(spark, d):
    """Everything the overview of the latest run shows, part by part, as numbers by name."""
    parts = dashboard.analytics(snapshot(spark, d), "month")
    top = parts["top_opportunities"].select(F.lit("opportunity").alias("part"), F.col("cluster_id").cast("string").alias("name"), F.col("rank").cast("double").alias("value"))
    series = parts["time_series"].select(F.lit("month").alias("part"), stamp(F.col("period_start")).alias("name"), F.col("total_problems").cast("double").alias("value"))
    return top.unionByName(series)


@register
def too_few_points(spark, d):
    """Fewer points than a cluster needs: all noise."""
    vectors = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return density.density_clusters(vectors, min_cluster_size=vectors.count() + 1)


@register
def exported_worklist(spark, d):
    """The written export, read back line by line."""
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    written = worklists.export_unclassified(X.source_items(spark, d), path)
    line = F.from_json("value", "source string, external_id string, document_text string").alias("line")
    return written.select(line).select("line.source", "line.external_id", F.sha2("line.document_text", 256).alias("digest"))


@register
def resumed_results(spark, d):
    """Half of the work list is classified, then a second call classifies what is missing."""
    work, path = worklists.unclassified(X.source_items(spark, d)), f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"

    def judge(name: str):
        verdict = (F.length("document_text") % 2 == 0).alias("is_problem")
        return lambda rows: rows.select(*KEY, verdict, F.lit(0.5).alias("confidence"), F.lit("by length").alias("reason"), F.lit(name).alias("classifier_name"))

    half = work.filter(F.pmod(F.col("external_id").cast("long"), F.lit(2)) == 0)
    worklists.append_results(spark, half, path, judge("first"))
    done = worklists.append_results(spark, work, path, judge("second"))
    return done.select(*KEY, flag(F.col("is_problem")).alias("is_problem"), "classifier_name")


# --- streaming --------------------------------------------------------------------------------


def _event_source(spark, d) -> DataFrame:
    stream = X.landed(spark, d, "events")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).filter(F.col("event_type") == "error")


def _drain(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what has landed and return its result table (one row per period)."""
    name = f"cairnflow_{uuid.uuid4().hex}"
    folder = f"{shared_folder(df.sparkSession)}/stream-{name}"
    query = (
        df.writeStream.format("memory")
        .queryName(name)
        .outputMode(mode)
        .option("checkpointLocation", folder)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return df.sparkSession.table(name)


def _stream_volume(spark, d, granularity: str) -> DataFrame:
    counted = _drain(volume.problem_volume(_event_source(spark, d), granularity), "complete")
    return counted.select(stamp(F.col("period_start")).alias("period_start"), "problem_count")


@register
def stream_daily_problems(spark, d):
    return _stream_volume(spark, d, "day")


@register
def stream_weekly_problems(spark, d):
    return _stream_volume(spark, d, "week")


@register
def stream_monthly_problems(spark, d):
    counted = volume.monthly(_drain(volume.problem_volume(_event_source(spark, d), "month"), "complete"))
    return counted.select(stamp(F.col("period_start")).alias("period_start"), "problem_count")


@register
def stream_insert_new(spark, d):
    raw = X.landed(spark, d, "documents").select(
        "source",
        F.col("doc_id").cast("string").alias("external_id"),
        F.col("n_chars"),
        F.timestamp_seconds(F.lit(1704067200)).alias("arrived_at"),
    )
    known = X.source_items(spark, d).filter(F.col("is_problem").isNotNull())
    folder = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    stream_ingest.ingest_new(raw, f"{folder}/table", f"{folder}/progress", lambda: known).awaitTermination()
    return read_or_empty(spark, f"{folder}/table", StructType([SOURCE_ITEMS[c] for c in KEY])).select(*KEY)
