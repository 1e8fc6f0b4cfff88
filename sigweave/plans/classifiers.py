"""What an experiment trains on lists of tokens: a linear model over hashed tokens, or a kernel machine over id vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave import dims
from sigweave.operators import kernel
from sigweave.plans.config import Config

#: Cells that the linear classifier hashes tokens to.
CELLS = 1 << 14
#: Kinds of model; the neural ones are stood in for by the linear one.
KINDS = ("llm", "cnn", "svm")


def hashed(lists: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=CELLS, inputCol="tokens", outputCol="features").transform(lists)


def padded_ids(tokens: Column, vocabulary: DataFrame, length: int) -> Column:
    """Ids of a list of tokens as numbers, cut and padded to `length`; the vocabulary has as many rows as its configuration allows, and every task a copy."""
    ids = {r.token: float(r.id) for r in vocabulary.select("token", "id").collect()}
    unknown, pad = float(dims.SPECIAL_TOKENS.index("<UNK>")), float(dims.SPECIAL_TOKENS.index("<PAD>"))

    @F.pandas_udf("array<double>")
    def made(lists: pd.Series) -> pd.Series:
        out = np.full((len(lists), length), pad)
        for i, row in enumerate(lists):
            row = [] if row is None else row[:length]
            out[i, : len(row)] = [ids.get(t, unknown) for t in row]
        return pd.Series(list(out))

    return made(tokens)


@dataclass
class Linear:
    """Multinomial logistic regression over hashed tokens."""

    model: LogisticRegressionModel

    def logits(self, lists: DataFrame) -> DataFrame:
        return self.model.transform(hashed(lists)).withColumn("logits", vector_to_array("rawPrediction")).drop("features", "rawPrediction", "probability", "prediction")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")


@dataclass
class Kernel:
    """A kernel machine over the ids of the tokens, at the lengths that the longest training list has (max_length at most)."""

    machine: kernel.KernelMachine
    vocabulary: DataFrame

    def logits(self, lists: DataFrame) -> DataFrame:
        ids = padded_ids(F.col("tokens"), self.vocabulary, self.machine.map.size)
        return self.machine.logits(lists.withColumn("__ids", ids), "__ids").drop("__ids")

    def save(self, path: str) -> None:
        self.machine.save(f"{path}/model")


Classifier = Linear | Kernel


def fit(train: DataFrame, vocabulary: DataFrame, config: Config, n_classes: int) -> Classifier:
    """The model that the configuration names, of rows (tokens, y)."""
    if config.model.model_type != "svm":
        labelled = train.withColumn("label", F.col("y").cast("double"))
        return Linear(LogisticRegression(family="multinomial", maxIter=50).fit(hashed(labelled)))
    longest = train.agg(F.max(F.size("tokens"))).first()[0] or 1
    rows = train.select(padded_ids(F.col("tokens"), vocabulary, min(longest, config.model.max_length)).alias("ids"), "y")
    return Kernel(kernel.fit(rows, "ids", "y", n_classes, seed=config.experiment.seed), vocabulary)


def load(kind: str, path: str, vocabulary: DataFrame) -> Classifier:
    """What `save` has left in the folder."""
    if kind not in KINDS:
        raise ValueError(f"unknown model type {kind!r}")
    return Kernel(kernel.KernelMachine.load(f"{path}/model"), vocabulary) if kind == "svm" else Linear(LogisticRegressionModel.load(f"{path}/model"))
