"""Session settings and the shared folder used for checkpoints and exchange files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
SPREAD_BYTES = 256 << 20
# an estimate beyond this is none
UNKNOWN_BYTES = 1 << 50


def local_session(cpus: int | str = "*", app_name: str = "condensa") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    cores = 8 if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(max(cores, 4)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the session.

    A machine-local folder is made only for a local master, where nothing is named. A `file:` folder
    that a cluster names has to be a mount that all machines share; a path does not tell.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="condensa-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a small table by `key` when it has fewer splits than the session has cores.

    Only tables of up to `SPREAD_BYTES` (Spark's own estimate) are dealt anew, whatever the number of
    cores; larger ones are split by `spark.sql.files.maxPartitionBytes` when they are read.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SPREAD_BYTES or df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, key)


def partitions_by_size(df: DataFrame, most_bytes: int) -> int:
    """Partitions of a shuffle of `df`: as many as the session's, and more for each `most_bytes` of input.

    By Spark's own estimate; where it has none, the session's number.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(usual, -(-size // most_bytes)) if size < UNKNOWN_BYTES else usual
