"""Cutting lineage on storage that outlives an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; only a local session gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
    context.setCheckpointDir(folder)


def durable(df: DataFrame) -> DataFrame:
    """Materialise once on shared storage; a lost executor re-reads instead of recomputing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder of a job on shared storage."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """As :func:`durable`, but as a columnar table: for wide rows read a few columns at a time."""
    spark = df.sparkSession
    path = work_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
