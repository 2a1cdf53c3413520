"""One ingestion batch: prepare, classify, embed only the problems, upsert everything."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.operators import aggregates, items, quality
from cairnflow.schemas import EMBEDDING_SIZE
from cairnflow.session import materialize
from cairnflow.sources.combined import union_sources

Stage = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Batch:
    """The next state of the item table and what the batch did."""

    table: DataFrame
    classified: DataFrame
    statistics: DataFrame


def ingest(existing: DataFrame, raw: DataFrame, classify: Stage, encode: Stage, size: int = EMBEDDING_SIZE) -> Batch:
    """Apply raw items to the table.

    ``classify`` adds the verdict columns and ``malformed``; ``encode`` takes problem rows (with a
    row ``id``) and adds ``embedding`` and ``embedding_model``. The classified batch is written once:
    scoring is the expensive step and its result is read by the encoder, the upsert and the report.
    """
    ordered = raw if "batch_order" in raw.columns else raw.withColumn("batch_order", F.monotonically_increasing_id())
    # An id of its own: the caller's batch order need not be unique. It is stored, so later reads agree on it.
    judged = materialize(classify(items.prepare(ordered)).withColumn("id", F.monotonically_increasing_id()), "classified")
    verdicts = judged.withColumnsRenamed({"problem_confidence": "confidence", "problem_reason": "reason", "problem_classifier": "classifier_name"})
    quality.enforce(quality.classification_violations(verdicts, *items.KEY), "invalid classification")
    vectors = encode(judged.filter("is_problem")).select("id", "embedding", "embedding_model")
    batch = materialize(judged.join(vectors, "id", "left").drop("id"), "batch")
    quality.enforce(items.rejected_vectors(existing, batch, size), "invalid embedding")
    return Batch(items.upsert(existing, batch), batch, aggregates.ingestion_statistics(batch))


def ingest_only(existing: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prepared rows to append (unclassified, keys not yet stored) and the per-source report."""
    ordered = raw if "batch_order" in raw.columns else raw.withColumn("batch_order", F.monotonically_increasing_id())
    return items.insert_new(existing, items.prepare(ordered)), aggregates.insertion_statistics(ordered, existing)


def collect_sources(
    readers: Mapping[str, Callable[[], DataFrame]], enabled, fail_fast: bool = True
) -> tuple[DataFrame | None, dict[str, str]]:
    """Union of the sources that can be read, and the error of each one that cannot.

    With ``fail_fast`` the first failing source raises. Reading is what fails here (a missing
    landing folder, a bad scope); the data is not touched yet.
    """
    ready: dict[str, DataFrame] = {}
    errors: dict[str, str] = {}
    for name in enabled:
        try:
            ready[name] = readers[name]()
        except Exception as error:
            if fail_fast:
                raise
            errors[name] = str(error)
    if not ready:
        return None, errors
    return union_sources(ready, list(ready)), errors


def append_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Add rows that lack optional columns to the item table."""
    missing = [f for f in table.schema.fields if f.name not in rows.columns]
    filled = reduce(lambda df, f: df.withColumn(f.name, F.lit(None).cast(f.dataType)), missing, rows)
    return table.unionByName(filled.select(*table.columns))
