"""Tables that long jobs write between their steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of `spark.checkpoint.dir`; in local mode without one, in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as Parquet in the shared folder, read again, which cuts its lineage."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, name: str, rows: int) -> DataFrame:
    """The frame without its lineage: by way of the driver if it has at most `rows` small rows, else written."""
    some = df.limit(rows + 1).collect()
    return written(df, name) if len(some) > rows else df.sparkSession.createDataFrame(some, df.schema)
