"""Numbering and windows of long series, on tables and on streams, and the monotone fit."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigweave.operators import calibration, ranks, segment
from sigweave.streaming import windows


def test_numbers_within_keys(spark):
    """A key of a third of the rows, ties in the first column of the order, null keys and null orders."""
    pick = random.Random(1)
    rows = [(pick.choice(["hot", None, f"k{i % 40}"]), pick.choice([None, pick.randrange(300), 7]), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "key string, t long, id long").repartition(6)
    got = {r.id: r.seq for r in ranks.numbered(frame, ["key"], ["t", "id"], ranges=16).collect()}
    want = {}
    for key in {k for k, _, _ in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: i for i, r in enumerate(own)}
    assert got == want
    assert ranks.numbered(frame.limit(0), ["key"], ["t", "id"]).count() == 0
    same = spark.createDataFrame([("a", 5, i) for i in range(50)], "key string, t long, id long")
    assert sorted(r.seq for r in ranks.numbered(same, ["key"], ["t", "id"]).collect()) == list(range(50))


@pytest.mark.parametrize(("length", "step"), [(8, 4), (5, 5), (3, 7), (1, 1), (10, 3)])
def test_counted_windows_equal_sliding(spark, length, step):
    series = {"a": 40, "b": 7, "c": 1, "d": length}
    rows = [(k, i, float(hash((k, i)) % 97)) for k, n in series.items() for i in range(n)]
    random.Random(0).shuffle(rows)
    long = spark.createDataFrame(rows, "k string, at long, v double")
    clips = long.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("samples"))
    want = {(r.k, r.window_idx, r.start): r.samples for r in segment.sliding(clips, length, step).collect()}
    got = {(r.k, r.window_idx, r.start): r.samples for r in segment.counted_windows(long, ["k"], "at", "v", length, step).collect()}
    assert got == want


def test_windows_of_a_plan_hold_no_series(spark, sf_dir):
    from sigweave.plans import queries

    plan = queries.sliding_segments(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "[user_id" in plan and "window_idx" in plan and "__range" in plan


def test_streamed_windows_equal_sliding(spark, tmp_path):
    """Samples arrive shuffled over several batches, some twice; one that comes behind the watermark leaves its windows out."""
    schema = "k string, at long, v double, t timestamp"
    series = {"a": 30, "b": 11, "c": 3}
    rows = [(k, i, float(i * i % 31), f"2024-01-01 00:00:{i:02d}") for k, n in series.items() for i in range(n)]
    rows += [rows[3], rows[8]]
    random.Random(4).shuffle(rows)
    lost = ("a", 5)
    batches = [[r for r in rows[i::3] if r[:2] != lost] for i in range(3)]
    batches += [[("z", 0, 0.0, "2024-01-01 02:00:00")], [("z", 1, 0.0, "2024-01-01 02:00:01")], [r for r in rows if r[:2] == lost][:1], [("z", 2, 0.0, "2024-01-01 04:00:00")], [("z", 3, 0.0, "2024-01-01 04:00:01")]]
    out = []
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
    for batch in batches:
        spark.createDataFrame(batch, "k string, at long, v double, t string").withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = windows.full_windows(stream, "k", "at", "v", "t", 4, 2, "10 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        out.append(query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else None)
    kept = spark.createDataFrame(sorted({r[:3] for r in rows if r[:2] != lost}), "k string, at long, v double")
    want = {(r.k, r.window_idx, r.start): r.samples for r in segment.counted_windows(kept, ["k"], "at", "v", 4, 2).collect()}
    found = spark.read.parquet(f"{tmp_path}/out").filter("k != 'z'").collect()
    got = {(r.k, r.window_idx, r.start): r.samples for r in found}
    assert got == want and len(found) == len(got) and len(want) >= 14
    # windows behind the watermark have no state any more
    assert out[-1] <= 4


def test_pooled_blocks_ascend():
    assert calibration.pooled([(0, 0, 1, 1), (1, 1, 0, 1), (2, 2, 1, 1)]) == [(0, 1, 1, 2), (2, 2, 1, 1)]
    assert calibration.pooled([]) == []
    assert calibration.pooled([(0, 0, 1, 2), (1, 1, 2, 4)]) == [(0, 1, 3, 6)]


def test_monotone_fit_equals_plain_pooling(spark):
    """A hundred thousand distinct confidences in many ranges against one loop over all, and the look-up of all of them."""
    n = 100_000
    frame = spark.range(n).select((F.xxhash64("id") / 2.0**64 + 0.5).alias("x"), (F.rand(3) < F.pow((F.xxhash64("id") / 2.0**64 + 0.5), 2)).cast("double").alias("total"), F.lit(1.0).alias("n")).persist()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = sorted(map(tuple, calibration.isotonic_blocks(frame).collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    points = sorted((r.x, r.x, r.total, r.n) for r in frame.collect())
    want = calibration.pooled(points)
    assert got == want and len(want) > 20
    steps = [(x, t / m) for low, high, t, m in want for x in ({low, high} and sorted({low, high}))]
    seen = frame.select("x", calibration.stepped(F.col("x"), steps).alias("v")).orderBy("x").collect()
    assert np.allclose([r.v for r in seen], np.interp([p[0] for p in points], *zip(*steps)))
    assert all(a.v <= b.v for a, b in zip(seen, seen[1:]))
    assert calibration.isotonic_blocks(frame.limit(0)).count() == 0
    assert spark.createDataFrame([(None,), (0.5,)], "x double").select(calibration.stepped(F.col("x"), steps).alias("v")).filter("v is null").count() == 1
