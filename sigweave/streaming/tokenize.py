"""Tokens of streamed events: fitted rules applied as they arrive, and windowed counts with late data bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.operators import binning, tokens


def tokenized(stream: DataFrame, rules: DataFrame, feature: str, value: str) -> DataFrame:
    """The events with bin_idx, level and token; the rules are a static table."""
    long = stream.withColumnsRenamed({feature: "feature", value: "value"})
    return binning.transform(long, rules).withColumn("token", tokens.token(F.col("feature"), F.col("level")))


def windowed_counts(events: DataFrame, time: str, length: str = "4 seconds", step: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """window, token, n. Windows start at multiples of the step since the epoch; events later than `late` are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, length, step), "token").agg(F.count("*").alias("n"))
