"""Numbers of rows in the order of a column, within keys of any size."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of the order that a key's rows are numbered in apart, and the accuracy at which their bounds are found.
RANGES, ACCURACY = 256, 10_000


def numbered(rows: DataFrame, key: list[str], order: list[str], name: str = "seq", ranges: int = RANGES) -> DataFrame:
    """Adds the place of each row in its key's order, from 0; `order` starts with a number, of which null comes first.

    The first column of the order is cut into ranges that hold about as many rows each, over
    all keys; rows are numbered within (key, range), and the counts of the key's lower
    ranges are added. So a task sorts one range of a key and not the key, and the counts are
    `ranges` rows a key at most. Rows that tie in all of `order` are numbered in any order.
    """
    first = F.col(order[0]).cast("double")
    at = [i / ranges for i in range(1, ranges)]
    found = rows.agg(F.percentile_approx(first, at, ACCURACY)).first()[0] or []
    cuts = sorted({c for c in found if c == c and abs(c) != float("inf")})
    dealt = rows.withColumn("__first", first)
    if cuts:
        # an order that isn't a number comes last
        parts = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="__first", outputCol="__range", handleInvalid="keep").transform(dealt)
        parts = parts.withColumn("__range", F.when(F.col("__first").isNull(), -1.0).otherwise(F.col("__range")))
    else:
        parts = dealt.withColumn("__range", F.lit(0.0))
    own = W.partitionBy(*key)
    counts = parts.groupBy(*key, "__range").agg(F.count("*").alias("__n"))
    below = F.coalesce(F.sum("__n").over(own.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.col("__range").alias("__of"), below.alias("__below"))
    same = parts["__range"] == starts["__of"]
    for i, k in enumerate(key):
        same &= parts[k].eqNullSafe(starts[f"__k{i}"])
    inner = F.row_number().over(W.partitionBy(*key, "__range").orderBy(*order)) - 1
    met = parts.withColumn("__inner", inner)
    out = met.join(starts, same)
    return out.select(*rows.columns, (F.col("__inner") + F.col("__below")).alias(name))
