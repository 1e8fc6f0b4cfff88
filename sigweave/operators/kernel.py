"""A classifier with a Gaussian kernel: random Fourier features under one hinge loss a class.

The inner product of two rows' features is exp(-gamma |x - y|^2) in expectation, so linear
machines over them are kernel machines, and their fit is a sum over rows that every task
adds its part to. The projections are hashes of a seed: the same on every run and engine.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Features, and machines that are fitted side by side.
WIDTH, SIDE_BY_SIDE = 512, 4


def uniform(*key: object) -> float:
    """A number in (0, 1) from the first 32 bits of a key's MD5."""
    return (int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:8], 16) + 0.5) / 2**32


@dataclass(frozen=True)
class FourierMap:
    """x of `size` numbers becomes sqrt(2 / width) cos(w_j x + b_j) for j below `width`; w_j is normal with variance 2 gamma, b_j uniform over a turn."""

    size: int
    gamma: float
    width: int = WIDTH
    seed: int = 42

    def projections(self) -> tuple[np.ndarray, np.ndarray]:
        """w (size by width) and b; a pair of hashed uniforms makes each normal number."""
        draws = np.array([[(uniform(self.seed, j, d, 0), uniform(self.seed, j, d, 1)) for j in range(self.width)] for d in range(self.size)]).reshape(self.size, self.width, 2)
        w = np.sqrt(-2 * np.log(draws[..., 0])) * np.cos(2 * np.pi * draws[..., 1]) * np.sqrt(2 * self.gamma)
        return w, np.array([2 * np.pi * uniform(self.seed, j, "b") for j in range(self.width)])

    def features(self, x: Column, then: tuple[np.ndarray, np.ndarray] | None = None) -> Column:
        """The features of an array column, an Arrow batch at a time, or with `then` (weights, offsets) what a linear step makes of them.

        Shorter rows count as padded with zeros, longer ones are cut, nulls are zeros.
        """
        size = self.size

        @F.pandas_udf("array<double>")
        def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            w, b = self.projections()
            for batch in batches:
                rows = np.zeros((len(batch), size))
                for i, v in enumerate(batch):
                    if v is not None:
                        v = np.nan_to_num(np.asarray(v, float)[:size])
                        rows[i, : len(v)] = v
                out = np.sqrt(2 / self.width) * np.cos(rows @ w + b)
                yield pd.Series(list(out if then is None else out @ then[0] + then[1]))

        return made(x)


def scale_gamma(rows: DataFrame, vector: str, size: int) -> float:
    """1 / (size * variance of all entries); 1 / size if they are all equal. Rows are padded with zeros to `size`."""
    n, mean, spread = rows.select(F.explode(F.slice(F.concat(vector, F.array_repeat(F.lit(0.0), size)), 1, size)).alias("v")).agg(F.count("v"), F.avg("v"), F.var_pop("v")).first()
    return 1.0 / (size * spread) if n and spread else 1.0 / size


@dataclass(frozen=True)
class KernelMachine:
    """A map, and the weights (width by classes) and offsets of the machines over it."""

    map: FourierMap
    weights: np.ndarray
    offsets: np.ndarray

    def logits(self, rows: DataFrame, vector: str) -> DataFrame:
        """The rows with `logits`: the margin of each class."""
        return rows.withColumn("logits", self.map.features(F.col(vector), (self.weights, self.offsets)))

    def save(self, path: str) -> None:
        """One row of JSON, written by Spark."""
        said = json.dumps({"map": asdict(self.map), "weights": self.weights.tolist(), "offsets": self.offsets.tolist()})
        SparkSession.active().createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, path: str) -> KernelMachine:
        said = json.loads(SparkSession.active().read.text(path).first()[0])
        return cls(FourierMap(**said["map"]), np.array(said["weights"]), np.array(said["offsets"]))


def fit(rows: DataFrame, vector: str, label: str, n_classes: int, cost: float = 1.0, gamma: float | None = None, width: int = WIDTH, seed: int = 42, rounds: int = 100) -> KernelMachine:
    """One machine a class against the rest, of rows (vector, label from 0 to n_classes - 1).

    Each minimises cost * (sum of hinge losses) + |w|^2 / 2. Rows without a vector or label
    are left out; without any row there is nothing to learn, which is an error. `gamma` is
    found from the entries' variance if it isn't given.
    """
    rows = rows.select(F.col(vector).cast("array<double>").alias("__v"), F.col(label).cast("double").alias("__y")).filter("__v is not null and __y is not null")
    n, size = rows.agg(F.count("*"), F.max(F.size("__v"))).first()
    if not n or not size:
        raise ValueError("there are no rows to learn from")
    made = FourierMap(size, scale_gamma(rows, "__v", size) if gamma is None else gamma, width, seed)
    mapped = rows.select(array_to_vector(made.features(F.col("__v"))).alias("__x"), "__y").persist()
    try:
        machine = LinearSVC(featuresCol="__x", labelCol="__y", regParam=1.0 / (cost * n), maxIter=rounds, standardization=False)
        found = OneVsRest(classifier=machine, featuresCol="__x", labelCol="__y", parallelism=SIDE_BY_SIDE).fit(mapped).models
    finally:
        mapped.unpersist()
    # a class of which no row was seen is never decided for
    found += [None] * (n_classes - len(found))
    weights = [np.zeros(width) if m is None else m.coefficients.toArray() for m in found]
    return KernelMachine(made, np.array(weights).T, np.array([-1e9 if m is None else m.intercept for m in found]))
