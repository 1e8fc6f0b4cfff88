"""Calibration of class probabilities and its measures; predictions hold (y int, logits or probs array<double>)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.operators.sampling import argmax

EPSILON = 1e-15


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    return F.get(F.transform(F.array(F.transform(logits, lambda x: F.exp((x - F.array_max(logits)) / t))), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, x: s + x))), F.lit(0))


def nll(probs: Column, y: Column) -> Column:
    return -F.ln(F.get(probs, y) + EPSILON)


def temperature_grid(predictions: DataFrame, temperatures: list[float]) -> DataFrame:
    """temperature, nll: the mean loss at each temperature; the rows are read once."""
    rows = predictions.select("y", "logits", F.explode(F.array(*map(F.lit, temperatures))).alias("temperature"))
    return rows.groupBy("temperature").agg(F.avg(nll(softmax(F.col("logits"), F.col("temperature")), F.col("y"))).alias("nll"))


def fit_temperature(predictions: DataFrame, low: float = 0.1, high: float = 10.0, points: int = 12, rounds: int = 5) -> float:
    """The temperature of least loss: a grid in each of some jobs, about the best point of the one before."""
    predictions = predictions.select("y", "logits").persist()
    try:
        return _best_temperature(predictions, low, high, points, rounds)
    finally:
        predictions.unpersist()


def _best_temperature(predictions: DataFrame, low: float, high: float, points: int, rounds: int) -> float:
    for _ in range(rounds):
        grid = [low + (high - low) * i / (points - 1) for i in range(points)]
        best = temperature_grid(predictions, grid).agg(F.min_by("temperature", F.struct("nll", "temperature"))).first()[0]
        step = (high - low) / (points - 1)
        low, high = max(low, best - step), min(high, best + step)
    return best


def confidence(probs: Column) -> Column:
    return F.array_max(probs)


def hits(predictions: DataFrame) -> DataFrame:
    """x, total, n: of each largest probability, how often its class was right, and how often it was given."""
    rows = predictions.select(confidence(F.col("probs")).alias("x"), (argmax(F.col("probs")) == F.col("y")).cast("double").alias("hit"))
    return rows.filter("x is not null and hit is not null").groupBy("x").agg(F.sum("hit").alias("total"), F.count("*").cast("double").alias("n"))


Block = tuple[float, float, float, float]


def pooled(blocks: Iterable[Block]) -> list[Block]:
    """Neighbouring blocks (low, high, total, n) put together until their means ascend."""
    out: list[Block] = []
    for low, high, total, n in blocks:
        while out and out[-1][2] * n >= total * out[-1][3]:
            low, total, n = out[-1][0], out[-1][2] + total, out[-1][3] + n
            out.pop()
        out.append((low, high, total, n))
    return out


#: Ranges of blocks that one task puts together at a time.
MERGED = 8
BLOCKS = "low double, high double, total double, n double"


def isotonic_blocks(points: DataFrame) -> DataFrame:
    """low, high, total, n of the blocks of the monotone fit of (x, total, n): a step function of ascending means.

    Each range of x pools its own points, and groups of neighbouring ranges pool what these
    left, until one is left: pooling first within ranges changes nothing. A task sees what
    remains of MERGED ranges, and the last one the fitted steps themselves.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        found = pooled((x, x, total, n) for b in batches for x, total, n in zip(*(c.to_pylist() for c in b.columns), strict=True))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(found), pa.int32()), *(pa.array(c, pa.float64()) for c in zip(*found, strict=True))], ["part", "low", "high", "total", "n"])

    def together(parts: pd.DataFrame) -> pd.DataFrame:
        found = pooled(parts.sort_values("low")[["low", "high", "total", "n"]].itertuples(index=False, name=None))
        return pd.DataFrame(found, columns=["low", "high", "total", "n"]).assign(part=int(parts["part"].iloc[0]) // MERGED)

    points = points.select("x", "total", "n")
    ranges = points.repartitionByRange("x").sortWithinPartitions("x").mapInArrow(own, f"part int, {BLOCKS}")
    last = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1  # ranges are numbered below this
    while last > 0:
        ranges = ranges.groupBy(F.floor(F.col("part") / MERGED)).applyInPandas(together, f"{BLOCKS}, part int").select("part", "low", "high", "total", "n")
        last //= MERGED
    return ranges.select("low", "high", "total", "n")


@dataclass(frozen=True)
class Isotonic:
    """The points of a monotone map."""

    boundaries: DenseVector
    predictions: DenseVector


def fit_isotonic(predictions: DataFrame) -> Isotonic:
    """A monotone map from the largest probability to how often its class is right; its steps are kept in the driver."""
    found = sorted((b.low, b.high, b.total / b.n) for b in isotonic_blocks(hits(predictions)).collect())
    points = [(x, value) for low, high, value in found for x in ([low, high] if high > low else [low])]
    return Isotonic(DenseVector([x for x, _ in points]), DenseVector([v for _, v in points]))


def isotonic_legacy(predictions: DataFrame, calibrated: Column) -> DataFrame:
    """Scales all probabilities by calibrated / largest and normalises them again, so the scale cancels: a calibrated value of 0 gives NaN."""
    scaled = F.transform("probs", lambda p: p * calibrated / F.array_max("probs"))
    total = F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x)
    return predictions.withColumn("probs", F.transform(scaled, lambda x: F.when(total == 0, float("nan")).otherwise(x / total)))


def isotonic_corrected(predictions: DataFrame, calibrated: Column) -> DataFrame:
    """The largest probability becomes the calibrated one; the others share the rest in proportion."""
    top, at = F.array_max("probs"), argmax(F.col("probs"))
    rest = F.when(top < 1, (1 - calibrated) / (1 - top)).otherwise(0.0)
    return predictions.withColumn("probs", F.transform("probs", lambda p, i: F.when(i == at, calibrated).otherwise(p * rest)))


def decided(predictions: DataFrame, names: list[str], least: float = 0.5) -> DataFrame:
    """Adds pred, pred_class, confidence and abstained (confidence under `least`)."""
    out = predictions.withColumn("pred", argmax(F.col("probs"))).withColumn("confidence", confidence(F.col("probs")))
    return out.withColumn("pred_class", F.get(F.array(*map(F.lit, names)), F.col("pred"))).withColumn("abstained", F.col("confidence") < least)


def bin_of(conf: Column, n_bins: int) -> Column:
    """The bin (low, high] of a confidence, from 0; null at and below 0. Edges are multiples of 1 / n_bins."""
    below = F.size(F.filter(F.array(*(F.lit(i * (1 / n_bins)) for i in range(n_bins))), lambda e: conf > e))
    return F.when(below > 0, below - 1)


def binned(predictions: DataFrame, n_bins: int) -> DataFrame:
    """bin, size, conf, acc of the bins that have rows."""
    conf, right = confidence(F.col("probs")), (argmax(F.col("probs")) == F.col("y")).cast("double")
    rows = predictions.select(conf.alias("c"), right.alias("r")).withColumn("bin", bin_of(F.col("c"), n_bins))
    return rows.groupBy("bin").agg(F.count("*").alias("size"), F.avg("c").alias("conf"), F.avg("r").alias("acc"))


def calibration_errors(predictions: DataFrame, n_bins: int = 10) -> DataFrame:
    """ece, ace, mce in one row: weighted mean, mean and maximum of the gaps of the bins with rows; 0 without any."""
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("conf") - F.col("acc")))
    out = binned(predictions, n_bins).agg((F.sum(gap * F.col("size")) / F.sum("size")).alias("ece"), F.avg(gap).alias("ace"), F.max(gap).alias("mce"))
    return out.fillna(0.0)


def scores(predictions: DataFrame) -> DataFrame:
    """brier, nll in one row."""
    brier = F.aggregate(F.transform("probs", lambda p, i: F.pow(p - (i == F.col("y")).cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)
    return predictions.agg(F.avg(brier).alias("brier"), F.avg(nll(F.col("probs"), F.col("y"))).alias("nll"))


def calibration_summary(predictions: DataFrame, n_bins: int = 10) -> DataFrame:
    return calibration_errors(predictions, n_bins).crossJoin(scores(predictions))


def reliability(predictions: DataFrame, n_bins: int = 15) -> DataFrame:
    """bin, size, conf, acc of all bins; an empty one has its middle as confidence and accuracy 0."""
    every = predictions.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    met = every.join(binned(predictions, n_bins), "bin", "left")
    middle = (F.col("bin") + 0.5) / n_bins
    return met.select("bin", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("conf", middle).alias("conf"), F.coalesce("acc", F.lit(0.0)).alias("acc"))


def histogram(df: DataFrame, value: str, n_bins: int = 30) -> DataFrame:
    """bin, n over the observed range; the last bin holds its upper edge."""
    span = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    at = F.when(F.col("__hi") == F.col("__lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * n_bins), F.lit(n_bins - 1)))
    counts = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(span)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").fillna(0, ["n"])


class Calibrator:
    """A calibration by name: `temperature` scales logits, `isotonic` maps the largest probability; others are an error.

    `fit` reads labelled predictions (y, logits, probs); `transform` replaces probs, and
    leaves rows without logits (temperature) or probabilities (isotonic) null.
    """

    def __init__(self, method: str = "temperature", corrected: bool = True) -> None:
        if method not in ("temperature", "isotonic"):
            raise ValueError(f"unknown calibration method {method!r}")
        self.method, self.corrected = method, corrected
        self.temperature: float | None = None
        self.steps: list[tuple[float, float]] | None = None

    def fit(self, predictions: DataFrame) -> Calibrator:
        if self.method == "temperature":
            self.temperature = fit_temperature(predictions)
        else:
            model = fit_isotonic(predictions)
            self.steps = list(zip(model.boundaries.toArray().tolist(), model.predictions.toArray().tolist(), strict=True))
        return self

    def transform(self, predictions: DataFrame) -> DataFrame:
        if self.temperature is None and self.steps is None:
            raise ValueError("the calibrator isn't fitted")
        if self.method == "temperature":
            return predictions.withColumn("probs", softmax(F.col("logits"), self.temperature))
        known = predictions.withColumn("__calibrated", stepped(confidence(F.col("probs")), self.steps))
        return (isotonic_corrected if self.corrected else isotonic_legacy)(known, F.col("__calibrated")).drop("__calibrated")

    def fit_transform(self, predictions: DataFrame) -> DataFrame:
        return self.fit(predictions).transform(predictions)

    def params(self, spark) -> DataFrame:  # noqa: ANN001
        """method, temperature, boundaries, values in one row, to be written as JSON."""
        steps = self.steps or []
        return spark.createDataFrame([(self.method, self.temperature, [x for x, _ in steps], [y for _, y in steps])], "method string, temperature double, boundaries array<double>, values array<double>")


def stepped(x: Column, steps: list[tuple[float, float]]) -> Column:
    """The line through (boundary, value) points at x, flat beyond the ends; null without points or x.

    The points are two literals, however many there are, and the place of x is found by halving.
    """
    if not steps:
        return F.lit(None).cast("double")
    n = len(steps)
    at, values = (F.lit(np.array(c, float)) for c in zip(*steps, strict=True))
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")

    def halved(s: Column, _: Column) -> Column:
        right = F.get(at, middle(s)) <= s["x"]
        return F.struct(F.when(right, middle(s) + 1).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(middle(s)).alias("hi"), s["x"].alias("x"))

    whole = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"), x.cast("double").alias("x"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), whole, halved)

    def line(s: Column) -> Column:
        below, above = s["lo"] - 1, s["lo"]
        share = (s["x"] - F.get(at, below)) / (F.get(at, above) - F.get(at, below))
        inner = F.get(values, below) + (F.get(values, above) - F.get(values, below)) * share
        return F.when(s["x"].isNotNull(), F.when(above == 0, F.get(values, F.lit(0))).when(above == n, F.get(values, F.lit(n - 1))).otherwise(inner))

    return F.get(F.transform(F.array(found), line), F.lit(0))


def pseudo_probabilities(pred: Column, n_classes: int, top: float = 0.7) -> Column:
    """Of a hard prediction: `top` for its class, an even share for the others, normalised."""
    even = 1 / n_classes
    raw = F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: F.when(k == pred, top).otherwise(even))
    return F.transform(raw, lambda p: p / (top + even * (n_classes - 1)))


def logits_of(probs: Column) -> Column:
    return F.transform(probs, lambda p: F.ln(p + 1e-8))
