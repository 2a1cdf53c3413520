"""Run history: latest run, latest compatible run, predecessor of every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnflow.operators.filters import compatible_runs
from cairnflow.schemas import RUN_METADATA


def latest_run(runs: DataFrame) -> DataFrame:
    """At most one row: the newest run, ties to the higher id."""
    return runs.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(1)


def latest_compatible_run(runs: DataFrame, metadata: dict, excluding: int | None = None) -> DataFrame:
    candidates = compatible_runs(runs, metadata)
    if excluding is not None:
        candidates = candidates.filter(F.col("id") != excluding)
    return latest_run(candidates)


def predecessors(runs: DataFrame) -> DataFrame:
    """``(id, previous_id)``: for every run the compatible run just before it.

    The window holds run headers (one short row per run), never run contents; NULL parameters
    group together, which is the compatibility rule.
    """
    before = Window.partitionBy(*RUN_METADATA).orderBy("created_at", "id")
    return runs.select("id", F.lag("id").over(before).alias("previous_id"))
