"""What the operators share: Arrow mapping, staging in the shared folder, bounded samples."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairnflow.session import materialize, shared_folder

#: Sorts after every real id: documents without an id count as the last ones.
NO_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` for kernels that turn one batch into some batches, without state between batches.

    Spark takes the columns of a result by place, so they are put into the order of ``schema`` here.
    """
    names = schema.names if isinstance(schema, StructType) else [column.split()[0] for column in schema.split(",")]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for found in kernel(batch):
                    yield found.select(names)

    return df.mapInArrow(run, schema)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """The id and text alone: whatever else the table has cannot clash with an operator's own columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


def remainder(modulus: int, column: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo: how labelled rows are split into learning and held-out ones."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % modulus


def bounded(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most ``rows`` rows, the ones whose keys hash lowest: the same rows in every run."""
    return df.orderBy(F.xxhash64(*keys), *keys).limit(rows)


def stage(df: DataFrame, name: str) -> DataFrame:
    return materialize(df, f"llm-{name}")


class Stages:
    """Intermediate results of one run, written to the shared folder and emptied together at its end.

    ``result`` writes what the run returns and then overwrites all others with nothing, so a pipeline of operators
    needs the space of one of them. Overwriting is what every file system that Spark writes to offers.
    """

    def __init__(self):
        self.written: list[tuple[str, DataFrame]] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_folder(df.sparkSession)}/cairnflow-llm-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        found = df.sparkSession.read.schema(df.schema).parquet(path)
        self.written.append((path, found))
        return found

    def release(self, *done: DataFrame) -> None:
        """Empty results that nothing reads any more."""
        for path, old in [w for w in self.written if any(w[1] is d for d in done)]:
            old.sparkSession.createDataFrame([], old.schema).write.mode("overwrite").parquet(path)
        self.written = [w for w in self.written if not any(w[1] is d for d in done)]

    def result(self, df: DataFrame, name: str) -> DataFrame:
        found = stage(df, name)
        self.release(*[old for _, old in self.written])
        return found


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int) -> DataFrame:
    """text and label of at most ``rows`` learning documents: those with a label whose ids hash lowest.

    The ids are bounded by ``rows``, so they are broadcast and no text is shuffled.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(modulus) != held_out))
    single = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    return texts(docs).join(F.broadcast(bounded(single, rows, "doc_id")), "doc_id").select("text", "label")


def held_out(modulus: int, value: int) -> Column:
    return F.coalesce(remainder(modulus) == value, F.lit(False)).alias("held_out")
