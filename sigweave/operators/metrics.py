"""Classification measures from counts of (true, pred), votes and label counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def confusion(predictions: DataFrame, n_classes: int) -> DataFrame:
    """true, pred, n for every pair of classes, 0 where there are no rows."""
    classes = predictions.sparkSession.range(n_classes)
    grid = classes.select(F.col("id").cast("int").alias("true")).crossJoin(classes.select(F.col("id").cast("int").alias("pred")))
    counts = predictions.groupBy(F.col("y").cast("int").alias("true"), F.col("pred").cast("int").alias("pred")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["true", "pred"], "left").fillna(0, ["n"])


def per_class(matrix: DataFrame) -> DataFrame:
    """class, support, precision, recall, f1 from a confusion in long form; zero denominators give 0."""
    hit = F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)
    rows = matrix.groupBy(F.col("true").alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    cols = matrix.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    met = rows.join(cols, "class")
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    met = met.withColumns({"precision": zero(F.col("tp"), F.col("predicted")), "recall": zero(F.col("tp"), F.col("support"))})
    f1 = zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return met.select("class", "support", "tp", "precision", "recall", f1.alias("f1"))


def summary(classes: DataFrame) -> DataFrame:
    """accuracy, macro_f1, weighted_f1 in one row."""
    total = F.sum("support")
    return classes.agg((F.sum("tp") / total).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / total).alias("weighted_f1"))


def decided_only(predictions: DataFrame, column: str = "pred_class", unknown: str = "unknown") -> DataFrame:
    """The predictions that name a class: nulls and `unknown` go before accuracy is measured."""
    return predictions.filter(F.col(column).isNotNull() & (F.col(column) != unknown))


def votes(df: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """key, label, n, first, share: how often each label was given, and its share of the key's."""
    counts = df.groupBy(key, label).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(key)))


def majority(df: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """The label given most often, the one seen first of equal ones, with n, share and confidence (the winner's share)."""
    best = votes(df, key, label, order).groupBy(key).agg(F.min_by(F.struct(label, "n", "share"), F.struct(-F.col("n"), F.col("first"))).alias("w"))
    return best.select(key, F.col(f"w.{label}").alias("winner"), "w.n", "w.share")
