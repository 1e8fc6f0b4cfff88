"""The kernel classifier and the recordings' data source."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sigweave.operators import kernel
from sigweave.plans import config, experiment, runs
from sigweave.sources import bids, brainvision


def rings(n, seed):
    pick = np.random.default_rng(seed)
    for i in range(n):
        y, turn = i % 2, pick.uniform(0, 2 * np.pi)
        r = (1 + 2 * y) + 0.2 * pick.normal()
        yield [float(r * np.cos(turn)), float(r * np.sin(turn))], y


def test_kernel_machine_parts_two_rings(spark, tmp_path):
    schema = "x array<double>, y int"
    train, test = spark.createDataFrame(list(rings(400, 1)), schema), spark.createDataFrame(list(rings(200, 2)), schema)
    machine = kernel.fit(train, "x", "y", 2, width=128)

    def accuracy(m):
        best = F.expr("array_position(logits, array_max(logits)) - 1")
        return m.logits(test, "x").agg(F.avg((best == F.col("y")).cast("int"))).first()[0]

    assert accuracy(machine) > 0.97
    machine.save(str(tmp_path))
    assert accuracy(kernel.KernelMachine.load(str(tmp_path))) == accuracy(machine)
    as_vector = lambda df: df.select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"))
    linear = LogisticRegression().fit(as_vector(train)).transform(as_vector(test)).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    assert linear < 0.65


def test_features_approach_the_kernel():
    """Inner products of features are near exp(-gamma |x - y|^2), the nearer the more features; draws don't depend on the width."""
    pick = np.random.default_rng(0)
    x = pick.normal(size=(40, 5))
    want = np.exp(-0.2 * ((x[:, None] - x[None]) ** 2).sum(-1))
    errors = []
    for width in (64, 4096):
        w, b = kernel.FourierMap(5, 0.2, width).projections()
        z = np.sqrt(2 / width) * np.cos(x @ w + b)
        errors.append(np.abs(z @ z.T - want).max())
    assert errors[1] < 0.1 < errors[0] < 0.8
    assert np.allclose(kernel.FourierMap(5, 0.2, 64).projections()[0], kernel.FourierMap(5, 0.2, 4096).projections()[0][:, :64])


def test_features_of_odd_rows(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([1.0, 0.0],), ([1.0, 2.0, 9.0],), (None,), ([],), ([0.0, float("nan")],)], "x array<double>")
    out = [r[0] for r in rows.select(kernel.FourierMap(2, 1.0, 8).features(F.col("x"))).collect()]
    assert out[0] == out[3] and out[1] == out[2] and out[4] == out[5] == out[6]
    assert kernel.scale_gamma(rows.filter("false"), "x", 4) == 0.25
    with pytest.raises(ValueError):
        kernel.fit(rows.filter("false").withColumn("y", F.lit(0)), "x", "y", 2)


def test_experiment_with_a_kernel_machine(spark, tmp_path):
    pick = np.random.default_rng(3)
    t = np.arange(64 * 24) / 64
    rows, labels = [], []
    for k in range(6):
        for i, c in enumerate(("C3", "C4")):
            rows.append((f"t{k}", c, i, (np.sin(2 * np.pi * (10 if k % 2 else 20) * t) * (2 + i) + 0.1 * pick.normal(size=len(t))).tolist()))
        labels.append((f"t{k}", k % 2))
    recordings = spark.createDataFrame(rows, "trial_id string, channel string, ch_idx int, samples array<double>")
    settings = config.Config().changed(data={"segment_length": 2.0}, model={"model_type": "svm"})
    result = experiment.run(recordings, spark.createDataFrame(labels, "trial_id string, y int"), 64.0, settings, 2)
    assert result.report.first().accuracy > 0.8 and result.report.first().model_type == "svm"
    runs.save(result, settings, str(tmp_path / "run"), ["closed", "open"])
    back = runs.load(spark, str(tmp_path / "run"))
    test = spark.read.schema("tokens array<string>, label string").json(f"{tmp_path}/run/test_data.json")
    assert runs.evaluate(back, test)[1].first().accuracy == pytest.approx(result.report.first().accuracy)


def folder(root, n=1000, orientation="MULTIPLEXED"):
    """Two recordings of three channels in two sessions, and three that can't be read."""
    tables = {}
    for s, session in enumerate(("a", "b")):
        at = root / f"sub-0{s}/ses-{session}/eeg"
        at.mkdir(parents=True)
        name = f"sub-0{s}_ses-{session}_task-memory"
        values = np.random.default_rng(s).integers(-1000, 1000, (n, 3)).astype("<i2")
        (at / f"{name}_eeg.vhdr").write_text(f"[Common Infos]\nNumberOfChannels=3\nSamplingInterval=4000\nDataOrientation={orientation}\n[Binary Infos]\nBinaryFormat=INT_16\n[Channel Infos]\nCh1=C3,,0.5\nCh2=Cz,,\nCh3=C4,,2\n")
        (values if orientation == "MULTIPLEXED" else values.T.copy()).tofile(at / f"{name}_eeg.eeg")
        tables[name] = values * np.array([0.5, 1, 2])
    (root / "sub-00/bad_eeg.vhdr").write_text("nothing")
    (root / "sub-00/bad_eeg.eeg").write_bytes(b"")
    (root / "sub-00/sub-09_ses-a_task-x_eeg.vhdr").write_text("[Common Infos]\nNumberOfChannels=1\nSamplingInterval=4000\n[Channel Infos]\nCh1=C3,,\n")
    return tables


@pytest.mark.parametrize("orientation", ["MULTIPLEXED", "VECTORIZED"])
def test_parts_of_a_recording_equal_the_whole(spark, tmp_path, orientation):
    tables = folder(tmp_path, orientation=orientation)
    rows = brainvision.pieces(spark, str(tmp_path), 1500 * 1)
    assert rows.rdd.getNumPartitions() >= 8
    got = {}
    for r in rows.filter("error is null").orderBy("start").collect():
        got.setdefault((r.trial_id, r.ch_idx), []).extend(r.samples)
    assert {k: len(v) for k, v in got.items()} == {(t, k): 1000 for t in tables for k in range(3)}
    assert all(np.array_equal(v, tables[t][:, k]) for (t, k), v in got.items())
    errors = {r.trial_id: r.error for r in rows.filter("error is not null").collect()}
    assert set(errors) == {"bad", "sub-09_ses-a_task-x"} and "no data" in errors["sub-09_ses-a_task-x"]
    whole = {(r.trial_id, r.ch_idx): r for r in bids.recordings(spark, str(tmp_path), 1500).collect()}
    assert all(np.array_equal(whole[k].samples, v) and whole[k].fs == 250.0 for k, v in got.items()) and len(whole) == 8


def test_filters_reach_the_source(spark, tmp_path):
    folder(tmp_path)
    rows = brainvision.pieces(spark, str(tmp_path), 1500)
    some = rows.filter("subject = '01' and channel in ('C3', 'Cz')")
    assert some.rdd.getNumPartitions() == 4
    assert {(r.subject, r.channel) for r in some.collect()} == {("01", "C3"), ("01", "Cz")}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan
    assert rows.filter("subject = 'none'").count() == 0
    # what the source can't decide stays with Spark
    assert rows.filter("start >= 500 and channel = 'C4'").agg(F.sum(F.size("samples"))).first()[0] == 2 * sum(len(range(s, min(s + 250, 1000))) for s in range(0, 1000, 250) if s >= 500)


def test_readers_filters_and_ranges():
    reader = brainvision.Reader("/", 100)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    kept = GreaterThan(("start",), 5)
    assert list(reader.pushFilters([EqualTo(("subject",), "01"), kept, In(("channel",), ("C3",))])) == [kept]
    assert reader.wanted == [("subject", ("01",)), ("channel", ("C3",))]


def test_empty_folder(spark, tmp_path):
    assert brainvision.pieces(spark, str(tmp_path)).count() == 0
