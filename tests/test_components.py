"""Components by sums over parts, against whole recordings; k-means with features that settle at different times."""

import numpy as np
from pyspark.sql import functions as F

from sigweave.operators import binning, components, spectral


def sources(n, seed=8):
    pick = np.random.default_rng(seed)
    t = np.arange(n) / 128.0
    blink = (np.sin(2 * np.pi * 2 * t) > 0.95).astype(float) * 5
    return blink, [np.sin(2 * np.pi * 10 * t), np.sign(np.sin(2 * np.pi * 7 * t)), pick.laplace(size=n)]


def recordings(spark, n, trials=(1, 2)):
    rows = []
    for trial in trials:
        blink, brain = sources(n, trial)
        rows += [(trial, f"c{k}", k, (sum((0.3 + ((k + j) % 3)) * b for j, b in enumerate(brain)) + (0.5 + k) * blink).tolist()) for k in range(6)]
        rows += [(trial, "eye", 6, (blink * 3).tolist())]
    rows += [(9, "c0", 0, [1.0, 2.0, 3.0]), (9, "c1", 1, [3.0, 1.0, 2.0])]
    return spark.createDataFrame(rows, "trial int, channel string, ch_idx int, samples array<double>")


def test_moments_and_unmixing_equal_the_whole(spark):
    clips = recordings(spark, 1500, (1,)).filter("trial = 1 and channel != 'eye'")
    x = np.stack([r.samples for r in clips.orderBy("ch_idx").collect()])
    found = components.blocks(clips, "trial", width=10)  # more parts than are merged in one task
    sums = components.moments(found, "trial")
    got = sums.first()
    assert got.n == 1500 and np.allclose(np.frombuffer(got.mean), x.mean(1))
    assert np.allclose(np.frombuffer(got.products).reshape(6, 6) / 1500, np.cov(x, bias=True))
    made = components.unmixed(found, "trial", sums, 4).first()
    mine = np.frombuffer(made.unmix).reshape(made.rows, made.cols)
    whole, _ = spectral.components_of(x, 4)
    assert mine.shape == whole.shape
    one, two = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (mine, whole))
    match = np.abs(one @ two.T)
    assert np.allclose(np.sort(match.max(1)), 1, atol=1e-6)


def test_cleaned_parts_equal_the_whole(spark):
    clips = recordings(spark, 1024)
    whole = {(r.trial, r.channel): np.array(r.samples) for r in spectral.without_artifacts(clips, "trial", 128.0, ["eye"], 4, limit=1.5).collect()}
    parts = components.without_artifacts(clips, "trial", 128.0, ["eye"], 4, limit=1.5, width=100)
    assert parts.columns == clips.columns
    got = {(r.trial, r.channel): np.array(r.samples) for r in parts.collect()}
    raw = {(r.trial, r.channel): np.array(r.samples) for r in clips.collect()}
    assert set(got) == set(whole) and all(np.allclose(got[k], whole[k], atol=1e-4) for k in whole)
    assert np.array_equal(got[1, "eye"], raw[1, "eye"]) and np.array_equal(got[9, "c0"], raw[9, "c0"])
    assert not np.allclose(got[1, "c5"], raw[1, "c5"], atol=0.1)


def test_kmeans_features_settle_apart(spark, monkeypatch):
    """The same rules whether centres go by way of the driver or are written; a constant feature and an empty cluster among them."""
    pick = np.random.default_rng(3)
    values = {"a": pick.gamma(2.0, size=300), "b": pick.normal(size=200), "c": [4.0] * 5, "d": [0.0, 0.1, 10.0]}
    frame = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "feature string, value double")
    kept = {r.feature: r.edges for r in binning.fit(frame, strategy="kmeans").collect()}
    monkeypatch.setattr(binning, "KEPT_RULES", 1)
    stored = {r.feature: r.edges for r in binning.kmeans(frame, 3).select("feature", "edges").collect()}
    assert all(np.allclose(stored[k], kept[k]) for k in "abd") and kept["c"] == [float("-inf"), float("inf")]
    assert len(kept["d"]) == 4 and frame.filter(F.col("feature") == "d").count() == 3
