"""Session settings this package expects, for a laptop and for a cluster."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Settings that hold at any scale: runtime re-planning, skew splitting, UTC.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "rasterspark") -> SparkSession:
    """A single-JVM session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEM", "8g"))
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> None:
    """Instants are compared as UTC milliseconds, so the session clock must be UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder lineage is cut into; a scratch one only where none is configured and all runs on this machine."""
    configured = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", ""
    )
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if configured:
        if not current:
            context.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    scratch = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
    context.setCheckpointDir(scratch)
    return scratch


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` once in the shared folder and read it back from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store_columns(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` stored compressed and by columns in the shared folder, and what deletes it.

    For wide tables whose last reader is known: a checkpoint is not compressed and stays until the driver collects garbage.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)

    def delete() -> None:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    return spark.read.schema(df.schema).parquet(path), delete


def tasks_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions that hold about ``per_task`` of ``rows`` each, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def deal_out(df: DataFrame, *columns: str, tasks: int | None = None) -> DataFrame:
    """Rows dealt out by hash over all shuffle partitions, or over ``tasks``, as small ones about to be multiplied are.

    The number is given, as adaptive execution would merge partitions by the size of the small rows.
    """
    return df.repartition(tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
