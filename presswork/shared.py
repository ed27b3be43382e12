"""Places that every executor and the driver can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset on one machine, as in tests, a fresh local one."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        configured = tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return configured


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder once and read it from there."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns_of(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Some columns of a table, read by a schema of these alone. Spark then takes the bytes of all files as the size of what is
    read. A selection's size is guessed from the whole row's width instead, which of a wide table makes millions of ids look
    small enough to pass whole through the driver in a broadcast."""
    whole = spark.read.parquet(path).schema
    return spark.read.schema(StructType([whole[c] for c in columns])).parquet(path)
