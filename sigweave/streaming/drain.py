"""Streams written as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sigweave import scratch


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What an appending stream gives for all input there is by now, as a table in the shared folder.

    Offsets and state are kept beside the table, so a batch whose executor is lost is done
    again and its rows stand in the table once. No row at all gives an empty table.
    """
    spark, path = stream.sparkSession, scratch.folder(stream.sparkSession, name)
    started = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")
    started.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
