"""Session defaults and the one way this package cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Semantics the operators rely on. Sizing (shuffle partitions, split bytes, memory) belongs to
# the deployment: AQE coalesces small shuffles and splits skewed ones at run time.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cairnflow")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CAIRNFLOW_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**REQUIRED_CONF, **conf}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the required runtime settings to a session somebody else built."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own: on a cluster a
    machine-local folder would be lost with its executor, so an unset value is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder before running iterative operators")
    folder = tempfile.mkdtemp(prefix="cairnflow-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def is_there(read) -> bool:
    """Whether a Spark reader finds its path; other errors of the reader are raised."""
    try:
        read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table, or no rows where nothing has been written yet."""
    reader = spark.read.schema(schema)
    return reader.parquet(path) if is_there(lambda: reader.parquet(path)) else spark.createDataFrame([], schema)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder once and return a scan of it.

    Unlike ``checkpoint()`` the plan runs a single time, the copy is columnar (later reads prune
    columns and push filters) and its size is known to the optimizer, so joins against it are
    broadcast only when they really are small. A lost executor costs a re-read, not a re-run.
    """
    return materialize_counted(df, name)[0]


def materialize_counted(df: DataFrame, name: str = "stage", metric: Column | None = None) -> tuple[DataFrame, int]:
    """``materialize`` plus a count taken while writing: of all rows, or an integer ``metric``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cairnflow-{name}-{uuid.uuid4().hex}"
    written = Observation()
    df.observe(written, (F.count(F.lit(1)) if metric is None else metric).alias("rows")).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), int(written.get["rows"])
