"""Streamed windows share the state of few groups, whatever their number."""

import inspect

from pyspark.sql import functions as F

from sigweave.operators import segment
from sigweave.streaming import windows


def test_windows_share_groups(spark, tmp_path):
    """Long keys beside a null, samples that repeat in a later file, and windows that are never full."""
    keys = [None, 0, (1 << 60) + 1, (1 << 60) + 2]
    rows = [(k, i, float(100 * n + i)) for n, k in enumerate(keys) for i in range(200) if (n, i) != (1, 50)]
    again = [(k, i, -1.0) for k, i, _ in rows[::3]]
    for number, part in enumerate((rows[::2], again, rows[1::2], again)):
        frame = spark.createDataFrame(part, "k long, at long, v double").withColumn("t", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("at") + 10 * number))
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    first = {}
    for k, i, v in [*rows[::2], *again, *rows[1::2]]:
        first.setdefault((k, i), v)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    few = {"buckets": 8} if "buckets" in inspect.signature(windows.full_windows).parameters else {}
    made = windows.full_windows(stream, "k", "at", "v", "t", 8, 4, "1 day", **few).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
    query = made.trigger(availableNow=True).start()
    query.awaitTermination()
    want = segment.counted_windows(spark.createDataFrame([(*k, v) for k, v in first.items()], "k long, at long, v double"), ["k"], "at", "v", 8, 4)
    as_set = lambda df: sorted(((r.k is None, r.k or 0, r.window_idx, r.start, tuple(r.samples)) for r in df.select("k", "window_idx", "start", "samples").collect()))
    got = as_set(spark.read.parquet(f"{tmp_path}/out"))
    assert got == as_set(want) and len(got) == 4 * 49 - 2
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8
