"""Declared schemas and enumerations; nothing in this package infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

# Statuses, granularities, coverage classes and scoring defaults of the public
# data model.
TREND_STATUSES = ("new", "rising", "stable", "falling")
MATCH_STATUSES = ("matched", "new")
GRANULARITIES = ("day", "week", "month")
COVERAGE_UNCOVERED = "non_presidiato"
COVERAGE_PARTIAL = "parzialmente_coperto"
COVERAGE_SATURATED = "saturo"
SATURATED_FROM = 5
EMBEDDING_SIZE = 384
CHANGE_THRESHOLD = 0.2
SIMILARITY_THRESHOLD = 0.8
SIMILARITY_TOLERANCE = 1e-12


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*field) for field in fields])


_S, _L, _I, _D, _B, _TS = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)

RAW_ITEMS = _struct(
    ("external_id", _S, False),
    ("source", _S, False),
    ("title", _S, False),
    ("body", _S, False),
    ("url", _S, False),
    ("author", _S, True),
    ("published_at", _TS, False),
    ("engagement_score", _I, True),
    ("raw_payload", _S, True),
)

SOURCE_ITEMS = _struct(
    ("id", _L, False),
    ("external_id", _S, False),
    ("source", _S, False),
    ("raw_payload", _S, True),
    ("title", _S, False),
    ("clean_title", _S, True),
    ("body", _S, False),
    ("clean_body", _S, True),
    ("url", _S, False),
    ("document_text", _S, True),
    ("is_problem", _B, True),
    ("problem_confidence", _D, True),
    ("problem_reason", _S, True),
    ("problem_classifier", _S, True),
    ("classified_at", _TS, True),
    ("embedding", T.ArrayType(T.FloatType()), True),
    ("embedding_model", _S, True),
    ("dedup_hash", _S, True),
    ("author", _S, True),
    ("published_at", _TS, False),
    ("processed_at", _TS, True),
    ("engagement_score", _I, True),
)

CLUSTER_RUNS = _struct(
    ("id", _L, False),
    ("created_at", _TS, False),
    ("embedding_model", _S, False),
    ("min_cluster_size", _I, False),
    ("min_samples", _I, True),
    ("metric", _S, False),
)
RUN_METADATA = ("embedding_model", "min_cluster_size", "min_samples", "metric")

CLUSTERS = _struct(
    ("id", _L, False),
    ("run_id", _L, False),
    ("local_cluster_id", _L, False),
    ("label", _S, True),
    ("keywords", T.ArrayType(T.StringType()), True),
    ("centroid", T.ArrayType(_D), True),
    ("document_count", _L, False),
    ("created_at", _TS, True),
)

CLUSTER_ITEMS = _struct(
    ("run_id", _L, False),
    ("cluster_id", _L, False),
    ("source_item_id", _L, False),
)

CLUSTER_TRENDS = _struct(
    ("run_id", _L, False),
    ("current_cluster_id", _L, False),
    ("previous_cluster_id", _L, True),
    ("label", _S, True),
    ("current_count", _L, False),
    ("previous_count", _L, False),
    ("absolute_change", _L, False),
    ("growth_rate", _D, True),
    ("status", _S, False),
    ("similarity", _D, True),
)

CLASSIFICATIONS = _struct(
    ("source", _S, False),
    ("external_id", _S, False),
    ("is_problem", _B, False),
    ("confidence", _D, False),
    ("reason", _S, False),
    ("classifier_name", _S, False),
)
