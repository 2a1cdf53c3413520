"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in a fixed shuffled order, gets a virtual finish time: the cumulative tokens of its
source up to and including it, divided by the source's target. Passes over a source follow each other, at most
``MAX_PASSES``. Sorted by finish time, the documents interleave so that every prefix has the target proportions;
the mix is the longest prefix within the total budget. Only sums per (source, bucket) and per finish-time bucket
are carried between tasks; no source is ordered in one task.

Defined cases: a null text has size 0; documents of size 0 are never taken; a null source is a source of its own
and comes last; repeated ids are separate documents; an empty table gives an empty result; equal finish times are
ordered by shuffle key, id and pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_PASSES = 3
# Buckets of the shuffle key per source, and of the finish time: at 10^12 documents some 10^6 rows a bucket.
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, source, size in words, and a shuffle key that depends on id and source alone."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat_ws("|", F.lit("mix"), F.col("doc_id").cast("string"), "source")).alias("turn"),
        *columns,
    )


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target: one row per source.

    Sources by code point (null last) weigh 1, 2, 3, repeating. A target stops at ``MAX_PASSES`` times the size of
    its source; the rest is shared again by weight. With the sources in the order of size over weight the capped
    ones come first, so one running sum finds the common level of all others.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighted = ranked.withColumn("weight", (F.col("nth") % 3 + 1).cast("double")).withColumn("cap", (MAX_PASSES * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(later)
    open_level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(Window.partitionBy())
    return (
        weighted.withColumn("level", level)
        .withColumn("open_level", open_level)
        .select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("open_level") * F.col("weight"), F.col("cap"))).alias("target"))
    )


def finish_times(docs: DataFrame, *columns: str) -> DataFrame:
    """One row per document and pass within the target, with ``finish`` in (0, 1] and ``bucket`` of it."""
    sizes = sized(docs, *columns).withColumn("slot", F.conv(F.substring("turn", 1, 3), 16, 10).cast("int"))
    goals = targets(sizes)
    slots = sizes.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.withColumn("slot_start", F.coalesce(F.sum("slot_size").over(before), F.lit(0))).drop("slot_size")
    small = starts.join(goals, starts.source.eqNullSafe(goals.source)).drop(goals.source)
    inside = Window.partitionBy("source", "slot").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sizes.withColumn("run", F.sum("size").over(inside))
    joined = placed.join(small, placed.source.eqNullSafe(small.source) & (placed.slot == small.slot)).drop(small.source).drop(small.slot)
    upto = F.col("slot_start") + F.col("run")
    # The passes whose finish time is at most 1, counted without making a row for each.
    passes = F.greatest(F.lit(0), F.least(F.lit(MAX_PASSES), F.floor((F.col("target") - upto) / F.nullif("source_size", F.lit(0))) + 1)).cast("int")
    return joined.withColumn("upto", upto).withColumn("passes", F.when(F.col("size") > 0, passes).otherwise(0)).drop("run", "slot_start", "slot")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document.

    Finish time 1 is where every source reaches its target, and the targets sum up to the budget: the longest prefix
    within the budget is everything that finishes by then. (Whole documents only, so each source stays below its
    target by less than one document.)
    """
    return finish_times(docs).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("passes")).alias("taken"), "source"
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself in fair order: the columns of ``docs``, once per pass taken, and ``mix_pass`` and ``mix_finish``
    (which take the place of columns of these names)."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    timed = finish_times(docs.withColumn("_row", row), "_row").where("passes > 0")
    copies = timed.withColumn("mix_pass", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    finish = (F.col("upto") + (F.col("mix_pass") - 1) * F.col("source_size")) / F.col("target")
    own = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("mix_pass", "mix_finish")]
    order = (finish, "turn", "doc_id", "mix_pass")
    return copies.repartitionByRange(*order).sortWithinPartitions(*order).select(*own, "mix_pass", finish.alias("mix_finish"))
