"""Plain Parquet tables: items in buckets of keys, runs in one folder each.

The item table is partitioned by a hash bucket of the key, and a batch is applied by overwriting the buckets that its
keys fall into; the files of all other buckets are neither read nor written. Every table function works key by key, so
it needs no more than those buckets. A dynamic overwrite replaces folders only once all tasks have written, so a job may read
the buckets that it rewrites, and a batch that failed half way can be applied again: the outcome is the same.

Keys whose 64-bit hashes are equal share a bucket, so the buckets that a batch touches hold every such case; the later key
gets another id.

A run becomes visible when its header row is written, which comes last; a failed attempt leaves nothing that readers see.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnflow.operators import quality
from cairnflow.operators.filters import compatible_runs
from cairnflow.operators.items import KEY, insert_new, key_hash, moved_ids, settle_ids, upsert
from cairnflow.operators.runs import latest_compatible_run
from cairnflow.schemas import CLUSTER_ITEMS, CLUSTER_RUNS, CLUSTER_TRENDS, CLUSTERS, RUN_METADATA, SOURCE_ITEMS
from cairnflow.session import materialize, read_or_empty

# Buckets of an item table: choose them so that one holds a few hundred megabytes. Fixed when the table is first written.
BUCKETS = 64
PLACE = T.StructType([T.StructField("buckets", T.IntegerType()), T.StructField("bucket", T.IntegerType())])


def bucket_of(buckets: int) -> Column:
    return F.pmod(key_hash(), F.lit(buckets)).cast("int")


def read_items(spark: SparkSession, path: str, schema: T.StructType = SOURCE_ITEMS) -> DataFrame:
    return read_or_empty(spark, path, T.StructType([*schema.fields, *PLACE.fields])).drop("buckets", "bucket")


def _touched(batch: DataFrame, path: str, schema: T.StructType, buckets: int) -> tuple[DataFrame, DataFrame]:
    """The batch, written once, and the stored rows of the buckets it touches."""
    spark = batch.sparkSession
    keyed = materialize(batch.withColumn("bucket", bucket_of(buckets)), "batch")
    # At most as many numbers as the table has buckets.
    numbers = [r.bucket for r in keyed.select("bucket").distinct().collect()]
    placed = read_or_empty(spark, path, T.StructType([*schema.fields, *PLACE.fields]))
    if not placed.filter(F.col("buckets") != buckets).isEmpty():
        raise ValueError("the table was written with another number of buckets")
    return keyed.drop("bucket"), placed.filter(F.col("bucket").isin(numbers)).drop("buckets", "bucket")


def _settled(rows: DataFrame, batch: DataFrame, stored: DataFrame) -> DataFrame:
    """``rows`` without ids that two keys share. The check reads keys alone, and hardly ever finds one."""
    moved = moved_ids(batch, stored)
    return rows if moved.isEmpty() else settle_ids(rows, moved)


def _write(rows: DataFrame, path: str, buckets: int, mode: str) -> None:
    placed = rows.withColumns({"buckets": F.lit(buckets), "bucket": bucket_of(buckets)}).repartition("bucket")
    placed.write.partitionBy("buckets", "bucket").mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(path)


def apply_batch(
    path: str, batch: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame] = upsert, buckets: int = BUCKETS, schema: T.StructType = SOURCE_ITEMS
) -> None:
    """Replace the buckets that ``batch`` touches by ``change(stored rows, batch)``: upsert, verdicts or vectors."""
    rows, stored = _touched(batch, path, schema, buckets)
    after = _settled(change(stored, rows), rows, stored).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    _write(after, path, buckets, "overwrite")


def append_new(path: str, batch: DataFrame, buckets: int = BUCKETS, schema: T.StructType = SOURCE_ITEMS) -> None:
    """Add the rows whose keys the table lacks, as new files; nothing stored is rewritten."""
    rows, stored = _touched(batch, path, schema, buckets)
    fresh = _settled(insert_new(stored, rows), rows, stored)
    typed = [(F.col(f.name) if f.name in fresh.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    _write(materialize(fresh.select(*typed), "fresh"), path, buckets, "append")


STARTED = T.StructType([T.StructField("id", T.LongType())])


@dataclass(frozen=True)
class RunStore:
    """Run tables under ``root``; every table has one folder per run."""

    spark: SparkSession
    root: str

    def _path(self, table: str, run_id: int | None = None) -> str:
        return f"{self.root}/{table}" + ("" if run_id is None else f"/run={run_id}")

    def _table(self, name: str, schema: T.StructType, run_id: int) -> DataFrame:
        return read_or_empty(self.spark, self._path(name, run_id), schema)

    def runs(self) -> DataFrame:
        return read_or_empty(self.spark, self._path("runs"), CLUSTER_RUNS)

    def run_ids(self) -> list[int]:
        """Committed runs: one short header row each."""
        return sorted(r.id for r in self.runs().select("id").collect())

    def clusters(self, run_id: int) -> DataFrame:
        return self._table("clusters", CLUSTERS, run_id)

    def members(self, run_id: int) -> DataFrame:
        return self._table("members", CLUSTER_ITEMS, run_id)

    def trends(self, run_id: int) -> DataFrame:
        return self._table("trends", CLUSTER_TRENDS, run_id)

    def next_run_id(self) -> int:
        """Beyond every id ever started, committed or not; taken as soon as it is given out."""
        started = read_or_empty(self.spark, self._path("started"), STARTED)
        number = (started.agg(F.max("id")).head()[0] or 0) + 1
        self.spark.range(number, number + 1).write.mode("append").parquet(self._path("started"))
        return number

    def previous_run(self, metadata: dict, excluding: int | None = None):
        """The header row of the newest compatible run, or None."""
        return latest_compatible_run(self.runs(), metadata, excluding).head()

    def write(self, table: str, run_id: int, rows: DataFrame, schema: T.StructType) -> DataFrame:
        if run_id in self.run_ids():
            raise ValueError(f"run {run_id} is already committed")
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        typed.write.mode("overwrite").parquet(self._path(table, run_id))
        return self._table(table, schema, run_id)

    def commit(self, run_id: int, metadata: dict, created_at=None) -> None:
        """Make the run visible; everything else about it has been written."""
        _check_metadata(metadata)
        moment = F.current_timestamp() if created_at is None else F.lit(created_at).cast("timestamp")
        header = self.spark.range(1).select(
            F.lit(run_id).alias("id"), moment.alias("created_at"), *[F.lit(metadata[c]).alias(c) for c in RUN_METADATA]
        )
        self.write("runs", run_id, header, CLUSTER_RUNS)

    def save_trends(self, run_id: int, trends: DataFrame, previous_run_id: int | None, metadata: dict) -> DataFrame:
        """Validate coverage and references, then write the trends of a run being built."""
        clusters = self.clusters(run_id).select(F.col("id").alias("cluster_id"), "document_count")
        if previous_run_id is None:
            before = clusters.limit(0)
        else:
            if previous_run_id == run_id:
                raise ValueError("the previous run must be another run")
            compatible = compatible_runs(self.runs(), metadata).filter(F.col("id") == previous_run_id)
            if compatible.isEmpty():
                raise ValueError("the previous run is missing or not compatible")
            before = self.clusters(previous_run_id).select(F.col("id").alias("cluster_id"), "document_count")
        quality.enforce(quality.coverage_violations(trends, clusters, "current_cluster_id"), "trends must cover every cluster once")
        quality.enforce(quality.trend_violations(trends, clusters, before), "invalid trend")
        return self.write("trends", run_id, trends.withColumn("run_id", F.lit(run_id)), CLUSTER_TRENDS)

    def delete_run(self, run_id: int) -> None:
        """Empty the header first, so that the run vanishes at once, then its tables."""
        for table, schema in (("runs", CLUSTER_RUNS), ("trends", CLUSTER_TRENDS), ("members", CLUSTER_ITEMS), ("clusters", CLUSTERS)):
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(self._path(table, run_id))

    def save_cluster(self, run_id: int, cluster: DataFrame, members: DataFrame) -> None:
        """Insert or replace one cluster (by local id) of a run that is not committed yet."""
        key = cluster.select("local_cluster_id")
        old = self.clusters(run_id)
        kept = old.join(key, "local_cluster_id", "left_anti")
        gone = old.join(key, "local_cluster_id", "left_semi").select(F.col("id").alias("cluster_id"))
        others = self.members(run_id).join(gone, "cluster_id", "left_anti")
        # Two tables change: both are staged before either is replaced.
        changed = [
            (table, materialize(rows.select(*schema.names), f"{table}-next"), schema)
            for table, rows, schema in (("clusters", kept.unionByName(cluster), CLUSTERS), ("members", others.unionByName(members), CLUSTER_ITEMS))
        ]
        for table, rows, schema in changed:
            self.write(table, run_id, rows, schema)


def _check_metadata(metadata: dict) -> None:
    if set(metadata) != set(RUN_METADATA):
        raise ValueError(f"run metadata must name exactly {', '.join(RUN_METADATA)}")
    if not isinstance(metadata["embedding_model"], str) or not metadata["embedding_model"].strip():
        raise ValueError("embedding_model must not be blank")


def series_history(store: RunStore, metadata: dict, problem_counts: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Run history rows for the dashboard series: one per compatible committed run.

    ``problem_counts`` is ``(id, total_problems)`` as recorded when each run was made.
    """
    headers = compatible_runs(store.runs(), metadata)
    trends = read_or_empty(store.spark, store._path("trends"), CLUSTER_TRENDS)
    counted = trends.groupBy(F.col("run_id").alias("id")).agg(
        F.count("*").alias("cluster_count"), *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in statuses]
    )
    measures = ["cluster_count", *[f"{s}_count" for s in statuses]]
    return (
        headers.join(counted, "id", "left")
        .join(problem_counts, "id", "left")
        .fillna(0, subset=[*measures, "total_problems"])
    )
