"""Insert-if-new ingestion of a landing zone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairnflow.operators.items import insert_new, moved_ids, settle_ids
from cairnflow.session import is_there

KEY = ["source", "external_id"]


def distinct_arrivals(raw: DataFrame, arrived: str = "arrived_at", horizon: str = "1 day") -> DataFrame:
    """Drop repeats of a key that arrive within ``horizon``; state older than that is evicted.

    Arrival time, not publication time, carries the watermark: old posts may arrive at any time.
    """
    return raw.withWatermark(arrived, horizon).dropDuplicatesWithinWatermark(KEY)


def ingest_new(
    raw: DataFrame,
    table: str,
    checkpoint: str,
    known: Callable[[], DataFrame] | None = None,
    arrived: str = "arrived_at",
    horizon: str = "1 day",
) -> StreamingQuery:
    """Append the rows whose key neither ``known()`` nor ``table`` holds yet, then stop.

    Every micro-batch goes to its own ``batch_id`` partition in overwrite mode, and reads the table
    without that partition. A batch that is retried after a failure therefore writes the same rows
    again instead of adding to them.
    """
    spark = raw.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.drop(arrived)
        # The first batch goes the same way with nothing seen, so all batches have the same columns.
        seen = fresh.select(*KEY).limit(0) if known is None else known().select(*KEY)
        if is_there(lambda: spark.read.parquet(table)):
            seen = seen.unionByName(spark.read.parquet(table).filter(F.col("batch_id") != batch_id).select(*KEY))
        rows, moved = insert_new(seen, fresh), moved_ids(fresh, seen)
        if not moved.isEmpty():
            rows = settle_ids(rows, moved)
        rows.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return (
        distinct_arrivals(raw, arrived, horizon)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
