"""Epochs rejected by kind of channel, and streams written as tables."""

from pyspark.sql import functions as F

from sigweave.operators import segment
from sigweave.plans import config, experiment
from sigweave.streaming import drain


def channels(spark):
    rows = [("a", "C3", "eeg", 0.0), ("a", "C3", "eeg", 90.0), ("a", "E1", "eog", 0.0), ("a", "E1", "eog", 140.0)]
    rows += [("b", "C3", "eeg", 0.0), ("b", "C3", "eeg", 140.0), ("c", "E1", "eog", 0.0), ("c", "E1", "eog", 160.0)]
    rows += [("d", "C3", "eeg", 0.0), ("d", "C3", "eeg", 100.0), ("e", "X", "misc", 0.0), ("e", "X", "misc", 900.0), ("f", "Y", None, 0.0), ("f", "Y", None, 900.0), ("g", "C3", "eeg", None), (None, "C3", "eeg", 1.0)]
    return spark.createDataFrame(rows, "epoch string, channel string, kind string, v double")


def test_epochs_by_kind(spark):
    rows = channels(spark)
    kept = segment.kept_by_kind(rows, ["epoch"], "channel", "kind", {"eeg": 100.0, "eog": 150.0})
    assert kept.columns == rows.columns
    # a: each channel within its own limit; b, c: over it; d: at the limit; e, f: no limit for the kind
    assert {r.epoch for r in kept.collect()} == {"a", "d", "e", "f", "g", None}
    assert segment.kept_by_kind(rows, ["epoch"], "channel", "kind", {}).count() == rows.count()
    assert segment.kept_by_kind(rows.limit(0), ["epoch"], "channel", "kind", {"eeg": 1.0}).count() == 0


def test_epochs_of_a_configuration_are_rejected(spark, tmp_path):
    made = config.Config()
    assert made.segmenter.reject == {"eeg": 100e-6, "eog": 150e-6}
    made = made.changed(segmenter={"tmin": -1.0, "tmax": 1.0, "baseline": None, "reject": {"eeg": 5.0}})
    samples = spark.createDataFrame([("r", "C3", "eeg", t / 2, 10.0 if t == 21 else 0.0) for t in range(40)], "trial_id string, channel string, kind string, t double, v double")
    markers = spark.createDataFrame([("r", 1, 5.0), ("r", 2, 10.0)], "trial_id string, marker_id long, at double")
    by = ["trial_id", "marker_id", "channel"]
    assert {r.marker_id for r in experiment.event_epochs(samples, markers, "trial_id", by, made, kind="kind").collect()} == {1}
    assert {r.marker_id for r in experiment.event_epochs(samples, markers, "trial_id", by, made).collect()} == {1, 2}


def test_drained_stream(spark, tmp_path):
    rows = spark.range(20).withColumn("v", F.col("id") * 2)
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = drain.drained(stream.filter("id >= 5"), "some")
    assert sorted(r.id for r in out.collect()) == list(range(5, 20))
    none = drain.drained(stream.filter("id < 0"), "none")
    assert none.columns == ["id", "v"] and none.count() == 0
