"""From raw documents to token ids: the stages a training corpus goes through."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.llm.bpe import encoded
from sigweave.llm.decontaminate import drop_leaks
from sigweave.llm.line_dedup import count_names, dedup_lines
from sigweave.llm.near_dup import drop_near_duplicates
from sigweave.llm.quality_model import drop_rejected
from sigweave.llm.shared import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    A null text counts as empty, other nulls as values of their own; rows without
    doc_id are judged but teach nothing, repeated rows are judged alike.
    """
    return drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those of which no word is left go. n_chars counts what is left.

    Documents that had no word before stay, as do null texts and rows without doc_id;
    rows that repeat a doc_id lose the same lines.
    """
    changed = F.col(count_names(docs.columns)[1]) > 0
    left = dedup_lines(docs).filter(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least doc_id.

    Null and blank texts resemble nothing and stay, rows without doc_id too; of rows
    that repeat a doc_id one stays.
    """
    return drop_near_duplicates(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts, and rows without doc_id, stay."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the text that they decode to; a null text has no token, and every row gives one."""
    out = encoded(docs, public_tokenizers.path("byte_bpe_50k.json"), decode=True)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("leaks", leaks), ("tokens", tokens)]

#: Edit distances, components and token ids are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each on the table that the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
