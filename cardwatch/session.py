"""Session settings and the shared folder for data that must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folder: tempfile.TemporaryDirectory | None = None


# bytes of a shuffle partition that AQE aims at, and the partitions that a shuffle starts with at least
PARTITION_BYTES, LEAST_PARTITIONS = 128 << 20, 200


def initial_partitions(input_bytes: int) -> int:
    """Partitions for a shuffle of the whole input; at most 100,000, as each map task keeps an index of them all."""
    return min(100_000, max(LEAST_PARTITIONS, -(-input_bytes // PARTITION_BYTES)))


def build_session(app_name: str = "cardwatch", master: str | None = None, input_bytes: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects.

    On a cluster leave `master` to spark-submit.  AQE is what sizes the
    shuffles: it coalesces small ones, splits skewed join partitions and turns a
    join into a broadcast only once the measured size is under the threshold.
    It only merges partitions, so name the size of the largest table in `input_bytes`: shuffles then start with one
    partition for each 128 MB of it (100 TB: 100,000 of 1 GB, which spill to disk).  Left out, Spark's number holds.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(PARTITION_BYTES))
        .config("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
        # the JVM never compiles methods above 8000 bytes of code: a very wide projection
        # runs faster split up than fused into one interpreted method
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    if input_bytes is not None:
        builder = builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(initial_partitions(input_bytes)))
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a temporary one in local mode only."""
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_folder is None:
        _local_folder = tempfile.TemporaryDirectory(prefix="cardwatch-")
    return _local_folder.name


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below this application's part of the shared folder."""
    return f"{_application_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/cardwatch/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Drop everything this application put in the shared folder.

    Call it last: DataFrames that came from `durable` cannot be read afterwards.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_application_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def durable(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts lineage like `checkpoint()`, survives the loss of any executor, and
    gives the optimiser real sizes and column pruning for what follows.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
