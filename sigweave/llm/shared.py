"""What the operators share: scratch tables in the cluster's shared folder, bounded broadcasts and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch holds, so that long texts stay within a Python worker's memory.
BATCH_ROWS = 500
#: Rows up to which a side is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`; where it is unset, a temporary one is set in local mode (tests), and an error raised on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hashed_share(key: str, rows: int, of: int) -> Column:
    """Whether a row is among those of the least hashes of its key, `rows` of `of` in expectation; all are if there are no more."""
    return F.lit(True) if of <= rows else F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 40)) < int(rows / of * (1 << 40))


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small, unless the session already says how large they are."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def sized_join(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with `right`, which is broadcast if a count (of a stored table) shows at most `rows` rows, and else shuffled."""
    few = right.limit(rows + 1).count() <= rows
    return left.join(F.broadcast(right) if few else right.hint("merge"), on, how)
