"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or one of our own where that is unset and there is but one machine (tests); else an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: a folder that all executors share is needed")
        named = f"file://{tempfile.mkdtemp(prefix='factloom-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


#: Bytes of files up to which Spark may broadcast what stands in them.
ROOM = 1 << 20


def large(df: DataFrame) -> DataFrame:
    """df, which is shuffled and not broadcast where it is joined, if it is read of more than ROOM bytes. Spark takes the size of
    compressed files for that of their rows, which are many times as large on the driver and in every executor."""
    return df.hint("merge") if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > ROOM else df


def kept(df: DataFrame) -> DataFrame:
    """df, written once and read again from the shared folder. A table, as the constraints that a checkpoint carries along
    can refer to columns that a union doesn't have."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_large(df: DataFrame) -> DataFrame:
    """df, written once, of rows that grow with the targets."""
    return large(kept(df))
