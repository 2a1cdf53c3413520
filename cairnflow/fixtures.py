"""Views of the test tables in the shape of the operators' inputs.

``FIXTURES.md`` gives the rules; the SQL twins of these views head the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "fixture-64"
VECTOR_SIZE = 64
MATCH_THRESHOLD = 0.4
CURRENT_RUN, PREVIOUS_RUN = 2, 1


_scans: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A scan of a test table; its footer is read once per application."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{name}.parquet")
    if key not in _scans:
        _scans[key] = spark.read.parquet(key[1])
    return _scans[key]


def landed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream over the files of a test table, which is one file or a folder of them.

    A path that is no pattern has to be a folder.
    """
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def source_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    joined = documents.join(labels, "doc_id", "left").join(vectors, "doc_id", "left")
    is_problem = F.col("quality") == 1
    return joined.select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").cast("string").alias("external_id"),
        "source",
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("body"),
        F.concat(F.lit("https://example.test/"), F.col("doc_id")).alias("url"),
        F.lit(None).cast("string").alias("author"),
        F.timestamp_seconds(F.lit(1704067200) + F.pmod("doc_id", F.lit(720)) * 3600).alias("published_at"),
        F.col("n_chars").cast("int").alias("engagement_score"),
        F.col("text").alias("document_text"),
        is_problem.alias("is_problem"),
        F.when(F.col("quality").isNotNull(), F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0).alias(
            "problem_confidence"
        ),
        F.when(is_problem, F.col("embedding")).alias("embedding"),
        F.when(is_problem & F.col("embedding").isNotNull(), F.lit(MODEL)).alias("embedding_model"),
        F.col("label").alias("vector_label"),
        F.col("embedding").alias("raw_vector"),
    )


def current_members(items: DataFrame) -> DataFrame:
    return items.filter(F.col("embedding").isNotNull()).select(
        (F.lit(100) + F.col("vector_label")).cast("long").alias("cluster_id"), F.col("id").alias("item_id"), "embedding"
    )


def previous_members(items: DataFrame) -> DataFrame:
    label = F.col("vector_label")
    problem = F.coalesce("is_problem", F.lit(False))
    kept = (
        F.when(label <= 2, problem & (F.pmod("id", F.lit(2)) == 0))
        .when(label <= 4, F.lit(True))
        .when(label <= 8, problem)
        .otherwise(F.lit(False))
    )
    return items.filter(F.col("raw_vector").isNotNull() & kept).select(
        label.cast("long").alias("cluster_id"), F.col("id").alias("item_id"), F.col("raw_vector").alias("embedding")
    )


def solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "supplier")
        .filter(F.col("s_acctbal") > 5000)
        .select(
            (F.lit(100) + F.pmod("s_nationkey", F.lit(12))).cast("long").alias("cluster_id"), F.col("s_name").alias("name")
        )
    )


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per day of events."""
    day = F.date_trunc("day", "ts").alias("created_at")
    types = {"new": "signup", "rising": "purchase", "stable": "view", "falling": "click"}
    daily = (
        event_stream(spark, sf_dir)
        .groupBy(day)
        .agg(
            F.count_if(F.col("event_type") == "error").alias("total_problems"),
            F.count_distinct("user_id").alias("cluster_count"),
            *[F.count_if(F.col("event_type") == kind).alias(f"{status}_count") for status, kind in types.items()],
        )
    )
    return daily.select(
        F.unix_date(F.to_date("created_at")).cast("long").alias("id"), *daily.columns
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("expected"))
    documents = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 400).alias("predicted"))
    return labels.join(documents, "doc_id")
