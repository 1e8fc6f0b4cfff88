"""Samples and splits whose draws are a hash of a key and a seed: the same on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of the hash that are ranked apart, so no task ranks all rows.
BUCKETS = 256


def draw(key: str, seed: int | str = 42) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))


def ranked(df: DataFrame, key: str, seed: int | str = 42, by: str | None = None) -> DataFrame:
    """Adds rank (from 0) in the order of the draw, and n; of each class apart if `by` is given.

    Rows are ranked within buckets of the hash, and the counts of lower buckets are
    added; the counts are BUCKETS rows for each class.
    """
    rows = df.withColumn("__d", draw(key, seed)).withColumn("__b", F.conv(F.substring("__d", 1, 2), 16, 10).cast("int"))
    classes = [] if by is None else [by]
    counts = rows.groupBy(*classes, "__b").agg(F.count("*").alias("__c"))
    own = W.partitionBy(*classes)
    low = own.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*classes, "__b", F.coalesce(F.sum("__c").over(low), F.lit(0)).alias("__s"), F.sum("__c").over(own).alias("n"))
    inner = F.row_number().over(W.partitionBy(*classes, "__b").orderBy("__d", key)) - 1
    if by is None:
        met = rows.join(F.broadcast(starts), "__b")  # BUCKETS rows
    else:
        renamed = starts.withColumnsRenamed({by: "__by", "__b": "__bb"})
        met = rows.join(renamed, rows[by].eqNullSafe(renamed["__by"]) & (rows["__b"] == renamed["__bb"])).drop("__by", "__bb")
    return met.withColumn("rank", inner + F.col("__s")).drop("__d", "__b", "__s")


#: Values that one task sorts at most when a rank is looked for, and the parts that a span of values is cut into.
SORTED, CUTS = 100_000, 256


def value_at(df: DataFrame, column: str, rank: int):  # noqa: ANN201
    """The value at a rank (from 0) of the column's order; None beyond the end.

    The span of values is cut by approximate quantiles and the part that holds the rank
    is looked at again, until it is small or all its values are equal.
    """
    rows = df.select(F.col(column).alias("v")).filter("v is not null")
    while True:
        n, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
        if not 0 <= rank < n:
            return None
        if low == high:
            return low
        if n <= SORTED:
            return rows.orderBy("v").offset(rank).limit(1).first().v
        cuts = sorted(set(rows.agg(F.percentile_approx("v", [k / CUTS for k in range(1, CUTS)], 10_000)).first()[0]))
        part = F.lit(0)
        for c in cuts:
            part = part + (F.col("v") > F.lit(c)).cast("int")
        sizes = {r.p: r.n for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
        at, below = 0, 0
        while below + sizes.get(at, 0) <= rank:
            below += sizes.get(at, 0)
            at += 1
        rank -= below
        rows = rows.filter((F.col("v") > F.lit(cuts[at - 1])) if at == len(cuts) else (F.col("v") <= F.lit(cuts[at])) & ((F.col("v") > F.lit(cuts[at - 1])) if at else F.lit(True)))


def split(df: DataFrame, key: str, test: float = 0.2, val: float = 0.1, seed: int | str = 42) -> DataFrame:
    """Adds split: exactly int(n * test) rows are test, then up to int(n * (test + val)) val, the rest train."""
    if not (0 < test < 1 and 0 < val < 1 and test + val < 1):
        raise ValueError("test and val must be shares that leave something to train on")
    rows = ranked(df, key, seed)
    name = F.when(F.col("rank") < F.floor(F.col("n") * F.lit(test)), "test").when(F.col("rank") < F.floor(F.col("n") * F.lit(test + val)), "val").otherwise("train")
    return rows.withColumn("split", name).drop("rank", "n")


def holdout(df: DataFrame, order: str, share: float = 0.8) -> DataFrame:
    """Adds split by position: the first `share` of the rows train, the others test."""
    cut = value_at(df, order, int(df.count() * share))
    return df.withColumn("split", F.lit("train") if cut is None else F.when(F.col(order) < F.lit(cut), "train").otherwise("test"))


def folds(df: DataFrame, key: str, k: int = 5, label: str | None = None, seed: int | str = 42) -> DataFrame:
    """Adds fold, by turns within each class, or over all rows without one."""
    return ranked(df, key, seed, label).withColumn("fold", F.pmod("rank", F.lit(k)).cast("int")).drop("rank", "n")


def balanced(df: DataFrame, key: str, label: str, least: int = 50, seed: int | str = 42) -> DataFrame:
    """As many rows of each class as the smallest has, or `least` if that is more; smaller classes stay whole."""
    size = df.groupBy(label).count().agg(F.greatest(F.min("count"), F.lit(least)).alias("__size"))
    return ranked(df, key, seed, label).crossJoin(F.broadcast(size)).filter("rank < __size").drop("rank", "n", "__size")


def per_class(df: DataFrame, key: str, label: str, n: int, seed: int | str = 42) -> DataFrame:
    """At most n rows of each class, with their number in the draw as shot."""
    return ranked(df, key, seed, label).filter(F.col("rank") < n).withColumn("shot", (F.col("rank") + 1).cast("int")).drop("rank", "n")


def choice(options: list[str], key: str, seed: int | str = 42) -> Column:
    """One of the options by the draw."""
    number = F.conv(F.substring(draw(key, seed), 1, 8), 16, 10).cast("long")
    return F.get(F.array(*map(F.lit, options)), F.pmod(number, F.lit(len(options))).cast("int"))


def paired(sequences: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    """Sequences with their labels, by a key that both have: what stands by place in two lists is never relied on. Rows without a partner go, as a shorter list ends a pairing."""
    return sequences.join(labels, key)


def concatenated(*parts: DataFrame) -> DataFrame:
    """The rows of all parts, columns by name; a column that a part lacks is null there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def label_ids(df: DataFrame, label: str) -> DataFrame:
    """label, label_id: the distinct labels in the order of their bytes, numbered from 0; nulls have none."""
    names = df.select(F.col(label).alias("label")).filter("label is not null").distinct()
    every = names.agg(F.array_sort(F.collect_list("label")).alias("all"))  # as many rows as there are classes
    return every.select(F.posexplode("all").alias("label_id", "label")).select("label", "label_id")


def argmax(values: Column) -> Column:
    """Place of the largest value, the first of equal ones, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
