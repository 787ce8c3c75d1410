"""Durable cuts in a plan: intermediate tables that survive the loss of executors.

They lie under ``spark.checkpoint.dir`` like checkpoints do, and are cleared together with them.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine gets a scratch folder. On a cluster that would be
    another disk on each machine, so there it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="passagework-"))
    return sc.getCheckpointDir()


def stage(df: DataFrame, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as parquet under the shared folder and return the path."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/stage-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into a table in the shared folder, and go on from there.

    Unlike a row-wise checkpoint, what follows reads only the columns it needs.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stage(df))


def widen(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a small input over all cores.

    Spark does not split files below ``openCostInBytes``, so an input with fewer bytes than that
    per core leaves cores idle. Anything larger passes through untouched: its text is never
    shuffled. The decision rests on the optimizer's size estimate and runs no job.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesOpenCostInBytes()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, *keys) if size < cores * split else df
