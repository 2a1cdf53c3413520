"""The item table: preparation, idempotent upsert, offline classification, late embeddings.

Every function returns the next state of the rows it is given; ``plans.store`` applies it to the key buckets a batch touches.
Keys are unique in the table, so the joins below cannot skew on the stored side, and repeats inside
a batch are folded by an aggregate that combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnflow.functions import text as X
from cairnflow.functions.vectors import is_valid_vector
from cairnflow.schemas import RAW_ITEMS, SOURCE_ITEMS

KEY = ["source", "external_id"]
VERDICT = ["is_problem", "problem_confidence", "problem_reason", "problem_classifier"]
VECTOR = ["embedding", "embedding_model"]
PREPARED = ["clean_title", "clean_body", "document_text", "dedup_hash"]


def key_hash() -> Column:
    """The id of a key, unless another key has the same one (``moved_ids``)."""
    return F.xxhash64(*KEY)


def clash_ranks(arriving: DataFrame, stored: DataFrame, hashed: Column | None = None) -> DataFrame:
    """(key, nth) of the arriving keys that are not the first ones of their hash.

    Stored keys come first, then the order of the keys decides. The ranking sees only keys that share a hash with another
    key: next to none of 64 bits.
    """
    hashed = key_hash() if hashed is None else hashed
    new = arriving.select(*KEY, hashed.alias("hash"), F.lit(1).alias("age"))
    old = stored.select(*KEY, hashed.alias("hash"), F.lit(0).alias("age"))
    keys = old.join(new.select("hash").distinct(), "hash", "left_semi").unionByName(new)
    ends = keys.groupBy("hash").agg(F.min(F.struct(*KEY)).alias("low"), F.max(F.struct(*KEY)).alias("high"))
    members = keys.join(ends.filter("low <> high"), "hash", "left_semi").groupBy("hash", *KEY).agg(F.min("age").alias("age"))
    nth = F.row_number().over(Window.partitionBy("hash").orderBy("age", *KEY)) - 1
    return members.withColumn("nth", nth).filter((F.col("age") == 1) & (F.col("nth") > 0)).select(*KEY, "nth")


def moved_ids(arriving: DataFrame, stored: DataFrame) -> DataFrame:
    """(key, moved): the ids of arriving keys whose hash belongs to another key. They hash their rank as well."""
    return clash_ranks(arriving, stored, key_hash()).select(*KEY, F.xxhash64(*KEY, "nth").alias("moved"))


def settle_ids(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """``rows`` with the ids of ``moved`` for the keys that it names."""
    given = rows.join(moved, KEY, "left").withColumn("id", F.coalesce("moved", "id"))
    return given.select(*rows.columns)


def prepare(raw: DataFrame, entities: str = "exact") -> DataFrame:
    """Add the cleaned title and body, their document text and its hash."""
    cleaned = raw.withColumns(
        {
            "clean_title": X.clean_text(F.col("title"), entities),
            "clean_body": X.clean_text(F.col("body"), entities),
        }
    )
    # Cleaned parts are already stripped and single-spaced, so neither the text nor the hash needs
    # another pass over the whole body: joining them by a blank is their whitespace-normal form.
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("clean_title", "clean_body")]
    return cleaned.withColumns(
        {
            "document_text": F.concat_ws("\n\n", *parts),
            "dedup_hash": F.sha2(F.lower(F.concat_ws(" ", *parts)), 256),
        }
    )


def _typed(name: str) -> Column:
    return F.lit(None).cast(SOURCE_ITEMS[name].dataType)


def _complete(incoming: DataFrame) -> DataFrame:
    """Add the optional columns a batch may lack."""
    missing = {c: _typed(c) for c in VERDICT + VECTOR if c not in incoming.columns}
    if "batch_order" not in incoming.columns:
        missing["batch_order"] = F.lit(0)
    return incoming.withColumns(missing) if missing else incoming


def fold_batch(incoming: DataFrame) -> DataFrame:
    """One row per key with the outcome of applying the batch in ``batch_order``.

    The last row gives the post itself, the last verdict the classification. A vector survives
    only if no later row declared the post a non-problem.
    """
    rows = _complete(incoming)
    order = F.col("batch_order")
    payload = [f.name for f in RAW_ITEMS.fields if f.name not in KEY] + PREPARED
    judged = F.when(F.col("is_problem").isNotNull(), order)
    embedded = F.when(F.col("embedding").isNotNull(), order)
    return rows.groupBy(*KEY).agg(
        F.max_by(F.struct(*payload), order).alias("post"),
        F.max_by(F.struct(*VERDICT), judged).alias("verdict"),
        F.max(F.when(~F.col("is_problem"), order)).alias("last_negative"),
        F.max_by(F.struct(*VECTOR), embedded).alias("vector"),
        F.max(embedded).alias("last_vector"),
    )


def upsert(existing: DataFrame, incoming: DataFrame, now: Column | None = None) -> DataFrame:
    """The item table after a batch.

    Post columns are always replaced. A classification is replaced only by a new one. A stored
    vector is kept unless the batch brings another or declares the post a non-problem.
    """
    now = F.current_timestamp() if now is None else now
    old, new = existing.alias("old"), fold_batch(incoming).alias("new")
    joined = old.join(new, KEY, "full_outer")
    touched = F.col("new.post").isNotNull()
    judged = F.col("new.verdict").isNotNull()
    cleared = F.col("new.last_negative").isNotNull()
    fresh_vector = F.col("new.last_vector").isNotNull() & (
        ~cleared | (F.col("new.last_vector") > F.col("new.last_negative"))
    )

    def pick(name: str) -> Column:
        if name == "id":
            return F.coalesce("old.id", key_hash())
        if name in KEY:
            return F.col(name)
        if name in VERDICT:
            return F.when(judged, F.col(f"new.verdict.{name}")).otherwise(F.col(f"old.{name}"))
        if name == "classified_at":
            return F.when(judged, now).otherwise(F.col("old.classified_at"))
        if name in VECTOR:
            return F.when(fresh_vector, F.col(f"new.vector.{name}")).when(~cleared, F.col(f"old.{name}"))
        if name == "processed_at":
            return F.when(touched, now).otherwise(F.col("old.processed_at"))
        return F.when(touched, F.col(f"new.post.{name}")).otherwise(F.col(f"old.{name}"))

    return joined.select(*[pick(f.name).cast(f.dataType).alias(f.name) for f in SOURCE_ITEMS.fields])


def rejected_vectors(existing: DataFrame, incoming: DataFrame, size: int) -> DataFrame:
    """Batch rows whose vector may not be stored, with the reason.

    A row without a verdict of its own is judged by the batch's last verdict, else by the table's.
    """
    rows = _complete(incoming).filter(F.col("embedding").isNotNull() | F.col("embedding_model").isNotNull())
    verdicts = (
        _complete(incoming)
        .filter(F.col("is_problem").isNotNull())
        .groupBy(*KEY)
        .agg(F.max_by("is_problem", "batch_order").alias("batch_verdict"))
    )
    stored = existing.select(*KEY, F.col("is_problem").alias("stored_verdict"))
    effective = F.coalesce("is_problem", "batch_verdict", "stored_verdict", F.lit(False))
    reason = (
        F.when(F.col("embedding").isNull(), "embedding_model requires an embedding")
        .when(X.is_blank(F.col("embedding_model")), "embedding requires an embedding_model")
        .when(~is_valid_vector(F.col("embedding"), size), "embedding must hold the declared number of finite values")
        .when(~F.col("effective"), "embedding requires a problem")
    )
    return (
        rows.join(verdicts, KEY, "left")
        .join(stored, KEY, "left")
        .withColumn("effective", effective)
        .select(*KEY, "batch_order", reason.alias("reason"))
        .filter(F.col("reason").isNotNull())
    )


def insert_new(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The rows to append: first of each key in the batch, and only keys the table lacks."""
    rows = incoming if "batch_order" in incoming.columns else incoming.withColumn("batch_order", F.lit(0))
    columns = [c for c in rows.columns if c not in KEY and c != "batch_order"]
    first = rows.groupBy(*KEY).agg(F.min_by(F.struct(*columns), "batch_order").alias("post"))
    fresh = first.join(existing.select(*KEY), KEY, "left_anti")
    return fresh.select(key_hash().alias("id"), *KEY, "post.*")


def import_outcomes(items: DataFrame, classifications: DataFrame, overwrite: bool = False) -> DataFrame:
    """Each classification with ``outcome``: imported, skipped (already classified) or missing."""
    stored = items.select(*KEY, F.lit(True).alias("found"), F.col("is_problem").alias("stored_verdict"))
    outcome = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("stored_verdict").isNotNull() & F.lit(not overwrite), "skipped")
        .otherwise("imported")
    )
    return classifications.join(stored, KEY, "left").select(*classifications.columns, outcome.alias("outcome"))


def import_report(outcomes: DataFrame) -> DataFrame:
    names = ("imported", "skipped", "missing")
    return outcomes.agg(*[F.count_if(F.col("outcome") == name).alias(name) for name in names])


def apply_classifications(
    items: DataFrame,
    classifications: DataFrame,
    overwrite: bool = False,
    now: Column | None = None,
) -> DataFrame:
    """The item table after an import. A dry run is ``import_report(import_outcomes(...))``."""
    now = F.current_timestamp() if now is None else now
    new = classifications.select(
        *KEY,
        F.struct(
            F.col("is_problem").alias("is_problem"),
            F.col("confidence").alias("problem_confidence"),
            F.col("reason").alias("problem_reason"),
            F.col("classifier_name").alias("problem_classifier"),
        ).alias("verdict"),
    )
    joined = items.alias("old").join(new, KEY, "left")
    applied = F.col("verdict").isNotNull() & (F.col("old.is_problem").isNull() | F.lit(overwrite))
    cleared = applied & ~F.col("verdict.is_problem")

    def pick(name: str) -> Column:
        if name in KEY:
            return F.col(name)
        if name in VERDICT:
            return F.when(applied, F.col(f"verdict.{name}")).otherwise(F.col(f"old.{name}"))
        if name == "classified_at":
            return F.when(applied, now).otherwise(F.col("old.classified_at"))
        if name in VECTOR:
            return F.when(~cleared, F.col(f"old.{name}"))
        return F.col(f"old.{name}")

    return joined.select(*[pick(c).alias(c) for c in items.columns])


def attach_embeddings(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """Store vectors ``(source, external_id, embedding, embedding_model)`` where none is stored."""
    new = vectors.select(*KEY, F.struct(*VECTOR).alias("vector"))
    joined = items.alias("old").join(new, KEY, "left")
    take = F.col("old.embedding").isNull() & F.coalesce("old.is_problem", F.lit(False))

    def pick(name: str) -> Column:
        if name in KEY:
            return F.col(name)
        if name in VECTOR:
            return F.when(take, F.col(f"vector.{name}").cast(items.schema[name].dataType)).otherwise(F.col(f"old.{name}"))
        return F.col(f"old.{name}")

    return joined.select(*[pick(c).alias(c) for c in items.columns])


def embedding_outcomes(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each vector's key with ``outcome``: embedded, kept, missing or not a problem."""
    stored = items.select(
        *KEY, F.lit(True).alias("found"), "is_problem", F.col("embedding").isNotNull().alias("has_vector")
    )
    outcome = (
        F.when(F.col("found").isNull(), "missing")
        .when(~F.coalesce("is_problem", F.lit(False)), "not a problem")
        .when(F.col("has_vector"), "kept")
        .otherwise("embedded")
    )
    return vectors.select(*KEY).join(stored, KEY, "left").select(*KEY, outcome.alias("outcome"))


def embedding_report(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count("*").alias("selected"),
        F.count_if(F.col("outcome") == "embedded").alias("embedded"),
        F.count_if(F.col("outcome").isin("missing", "not a problem")).alias("errors"),
    )


def missing_members(members: DataFrame, items: DataFrame) -> DataFrame:
    """Membership rows whose document does not exist."""
    return members.join(items.select(F.col("id").alias("item_id")), "item_id", "left_anti")
