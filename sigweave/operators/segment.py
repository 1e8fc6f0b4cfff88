"""Windows of recordings: sliding segments, epochs about events, baseline, crop and rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sliding(clips: DataFrame, length: int, step: int) -> DataFrame:
    """One row for each full window of an array of samples: window_idx, start, samples."""
    if length < 1 or step < 1:
        raise ValueError("length and step must be positive")
    starts = F.when(F.size("samples") >= length, F.sequence(F.lit(0), F.size("samples") - length, F.lit(step)))
    others = [c for c in clips.columns if c != "samples"]
    rows = clips.select(*others, "samples", F.posexplode(starts).alias("window_idx", "start"))
    return rows.select(*others, "window_idx", "start", F.slice("samples", F.col("start") + 1, F.lit(length)).alias("samples"))


def windows_of(at: Column, length: int, step: int) -> Column:
    """Numbers of the windows that sample `at` (from 0) lies in: those that start at a multiple of the step, `length` samples or fewer before it."""
    if length < 1 or step < 1:
        raise ValueError("length and step must be positive")
    first, last = F.greatest(F.ceil((at - (length - 1)) / step), F.lit(0)), F.floor(at / step)
    return F.when(first <= last, F.sequence(first.cast("long"), last.cast("long")))


def counted_windows(samples: DataFrame, key: list[str], at: str, value: str, length: int, step: int) -> DataFrame:
    """key, window_idx, start, samples of each full window of rows (key, at, value), `at` being the sample's number.

    What `sliding` gives for an array, without one: a row goes to the few windows that its
    number says, so a task holds windows and not a series.
    """
    rows = samples.select(*key, F.col(at).alias("__at"), F.col(value).alias("__v"), F.explode(windows_of(F.col(at), length, step)).alias("window_idx"))
    parts = rows.groupBy(*key, "window_idx").agg(F.array_sort(F.collect_list(F.struct("__at", "__v"))).alias("__w"))
    full = parts.filter(F.size("__w") == length)
    return full.select(*key, F.col("window_idx").cast("int").alias("window_idx"), (F.col("window_idx") * step).alias("start"), F.transform("__w", lambda x: x["__v"]).alias("samples"))


def epochs(samples: DataFrame, markers: DataFrame, key: str, tmin: float, tmax: float) -> DataFrame:
    """Samples (key, t, v) within tmin and tmax seconds of a marker (key, marker_id, at) of the recording; rel is the time from it.

    Times are put into bins as wide as the window, so the join is one of equal bins
    (each marker meets two or three) and not of all samples with all markers.
    """
    width = max(tmax - tmin, 1e-9)
    bins = markers.withColumn("__bin", F.explode(F.sequence(F.floor((F.col("at") + tmin) / width), F.floor((F.col("at") + tmax) / width))))
    met = samples.withColumn("__bin", F.floor(F.col("t") / width)).join(bins, [key, "__bin"])
    rel = F.col("t") - F.col("at")
    return met.filter((rel >= tmin) & (rel <= tmax)).withColumn("rel", rel).drop("__bin")


def baseline_corrected(rows: DataFrame, by: list[str], low: float = -1.0, high: float = 0.0) -> DataFrame:
    """v less its mean over the baseline of its epoch; epochs without baseline samples stay as they are."""
    base = rows.groupBy(*by).agg(F.avg(F.when(F.col("rel").between(low, high), F.col("v"))).alias("__base"))
    return rows.join(base, by).withColumn("v", F.col("v") - F.coalesce("__base", F.lit(0.0))).drop("__base")


def cropped(rows: DataFrame, start: float = 0.5, duration: float = 3.0) -> DataFrame:
    return rows.filter(F.col("rel").between(start, start + duration))


def kept_epochs(rows: DataFrame, epoch: list[str], channel: str, limit: float | Column) -> DataFrame:
    """Epochs of which no channel's peak-to-peak amplitude is over the limit."""
    span = rows.groupBy(*epoch, channel).agg((F.max("v") - F.min("v")).alias("__span"))
    worst = span.groupBy(*epoch).agg(F.max("__span").alias("__span")).filter(F.col("__span") > limit)
    return rows.join(worst.select(*epoch), epoch, "left_anti")


def kept_by_kind(rows: DataFrame, epoch: list[str], channel: str, kind: str, limits: dict[str, float]) -> DataFrame:
    """Epochs of which no channel's peak-to-peak amplitude is over the limit of its kind; kinds without a limit aren't judged.

    The rows go to one group for each channel of an epoch; only the rejected epochs meet them again.
    """
    if not limits:
        return rows
    allowed = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))
    span = rows.groupBy(*epoch, channel, kind).agg((F.max("v") - F.min("v")).alias("__span"))
    over = span.filter(F.col("__span") > F.try_element_at(allowed, F.col(kind).cast("string"))).select(*epoch).distinct()
    return rows.join(over, epoch, "left_anti").select(rows.columns)


def epoch_info(rows: DataFrame, label: str, epoch: str, t: str) -> DataFrame:
    """Counts by class: epochs, samples, first and last time."""
    return rows.groupBy(label).agg(F.count_distinct(epoch).alias("n_epochs"), F.count("*").alias("n_samples"), F.min(t).alias("t_first"), F.max(t).alias("t_last"))


def epoch_table(rows: DataFrame, epoch: str, channel: str, rel: str, v: str, label: str, channels: list[str], times: list[float], limit: int = 10_000) -> DataFrame:
    """One row for each epoch: a column for each channel and time, in this order and named as in C3_0.250s, and `label`.

    Rows are (epoch, label, channel, rel, v); times are told apart by milliseconds. A sample that
    isn't there is null. An epoch's label is its least.
    """
    if len(channels) * len(times) > limit:
        raise ValueError(f"{len(channels) * len(times)} columns; at most {limit}")
    same = lambda c, t: (F.col(channel) == c) & (F.round(F.col(rel) * 1000) == round(t * 1000))
    columns = [F.max(F.when(same(c, t), F.col(v))).alias(f"{c}_{t:.3f}s") for c in channels for t in times]
    return rows.groupBy(epoch).agg(*columns, F.min(label).alias("label"))
