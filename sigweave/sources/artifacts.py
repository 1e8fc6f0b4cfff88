"""Artifacts of an experiment as JSON and Parquet: rules, vocabularies, test data, reports. Nothing is pickled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE = "feature string, edges array<double>, labels array<string>"
VOCAB = "token string, id long, freq long"


def save_rules(rules: DataFrame, path: str) -> None:
    rules.select("feature", F.transform("edges", lambda e: F.when(F.abs(e) < float("inf"), e)).alias("edges"), "labels").write.mode("overwrite").json(path)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules as saved; infinite edges of constant features were written as nulls."""
    rows = spark.read.schema(RULE).json(path)
    return rows.withColumn("edges", F.transform("edges", lambda e, i: F.coalesce(e, F.when(i == 0, float("-inf")).otherwise(float("inf")))))


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").json(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VOCAB).json(path)


def save_splits(rows: DataFrame, path: str) -> None:
    """One folder for each value of `split`."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """The rows of one part; the folders of others aren't read."""
    return spark.read.parquet(path).filter(F.col("split") == split)


def load_test_data(spark: SparkSession, path: str) -> DataFrame:
    """idx, tokens, label of a file {token_sequences, labels}; the shorter list decides."""
    if not path.endswith(".json"):
        raise ValueError(f"unknown kind of file: {path}")
    rows = spark.read.schema("token_sequences array<array<string>>, labels array<string>").option("multiLine", True).json(path)
    n = F.least(F.size("token_sequences"), F.size("labels"))
    pairs = F.slice(F.arrays_zip("token_sequences", "labels"), F.lit(1), n)
    return rows.select(F.posexplode(pairs).alias("idx", "x")).select("idx", F.col("x.token_sequences").alias("tokens"), F.col("x.labels").alias("label"))


def save_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def save_predictions(predictions: DataFrame, path: str) -> None:
    """One object to a line, written by as many tasks as there are."""
    predictions.write.mode("overwrite").json(path)


def save_tokenizer(rules: DataFrame, vocab: DataFrame, settings: dict, path: str) -> None:
    """A fitted tokenizer as a folder: rules, vocabulary, and its settings (texts) as a map. Nothing is pickled."""
    save_rules(rules, f"{path}/rules")
    save_vocabulary(vocab, f"{path}/vocabulary")
    pairs = [(str(k), str(v)) for k, v in settings.items()]
    rules.sparkSession.createDataFrame(pairs, "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/settings")


def load_tokenizer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    settings = spark.read.schema("name string, value string").json(f"{path}/settings").collect()  # a few settings
    return load_rules(spark, f"{path}/rules"), load_vocabulary(spark, f"{path}/vocabulary"), {r.name: r.value for r in settings}


def save_tokenized(lists: DataFrame, path: str) -> None:
    """Token sequences with labels and feature vectors, as Parquet."""
    lists.write.mode("overwrite").parquet(path)


def wide(rows: DataFrame, key: str, name: str, value: str, columns: list[str], limit: int = 10_000) -> DataFrame:
    """One row for each key and one column for each of the named values."""
    if len(columns) > limit:
        raise ValueError(f"{len(columns)} columns; at most {limit}")
    return rows.groupBy(key).pivot(name, columns).agg(F.first(value))
