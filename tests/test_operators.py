"""Semantics that are easy to get wrong, on small frames."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigweave import dims
from sigweave.operators import binning, calibration, metrics, prompts, sampling, segment, spectral, tokens
from sigweave.plans import config, experiment
from sigweave.sources import artifacts, bids
from sigweave.streaming import tokenize


def long(spark, values, feature="f"):
    return spark.createDataFrame([(feature, None if v is None else float(v)) for v in values], "feature string, value double")


def test_value_on_an_edge_goes_up(spark):
    frame = long(spark, [0, 1, 2, 3, 4, 5, 6])
    rules = binning.fit(frame, 3)
    edges = rules.first().edges
    assert np.allclose(edges, np.percentile(range(7), [0, 100 / 3, 200 / 3, 100]))
    out = {r.value: r.bin_idx for r in binning.transform(long(spark, [edges[1], -9, 99, 3, None]), rules).collect()}
    assert out[edges[1]] == 1 and out[-9] == 0 and out[99] == 2 and out[3] == 1 and out[None] is None


def test_ties_collapse_edges_and_labels_shift(spark):
    out = binning.fit_transform(long(spark, [0] * 8 + [1, 2]))
    assert {r.level for r in out.collect()} <= {"LOW", "MEDIUM"}


def test_constant_feature_has_one_bin(spark):
    assert {r.level for r in binning.fit_transform(long(spark, [4, 4, 4])).collect()} == {"LOW"}


def test_kmeans_separates_clusters(spark):
    out = binning.fit_transform(long(spark, [0, 0.1, 5, 5.1, 9, 9.2]), strategy="kmeans")
    assert [r.bin_idx for r in out.orderBy("value").collect()] == [0, 0, 1, 1, 2, 2]


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        binning.fit(long(spark, [1]), 1)
    with pytest.raises(ValueError):
        binning.fit(long(spark, [1]), 3, "other")
    with pytest.raises(ValueError):
        prompts.encoded(spark.createDataFrame([(["a"], 1)], "tokens array<string>, label int"), "other")
    with pytest.raises(ValueError):
        spectral.psd(spark.createDataFrame([([1.0],)], "samples array<double>"), 1.0, 4, 4)


def test_nothing_to_fit_to_is_an_error(spark):
    with pytest.raises(ValueError, match="no values"):
        binning.fit(long(spark, [None, float("nan")]))
    rules = binning.fit(long(spark, [1, 2, 3]))
    assert binning.transform(long(spark, []), rules).count() == 0


def test_exact_quantiles_over_ranges(spark):
    rng = np.random.default_rng(2)
    a, b = np.round(rng.normal(size=3000), 2), rng.integers(0, 3, 500).astype(float)
    frame = long(spark, a, "a").union(long(spark, b, "b")).union(long(spark, [7.0], "c"))
    out = {r.feature: r.q for r in binning.quantiles(frame, [0.0, 0.2, 1 / 3, 0.5, 0.9, 1.0]).collect()}
    for name, x in (("a", a), ("b", b), ("c", [7.0])):
        assert np.allclose(out[name], np.quantile(x, [0, 0.2, 1 / 3, 0.5, 0.9, 1]), atol=1e-12)


def test_kmeans_equals_a_plain_version(spark):
    x = np.random.default_rng(3).gamma(2.0, size=400)
    edges = np.linspace(x.min(), x.max(), 4)
    centres = (edges[1:] + edges[:-1]) / 2
    for _ in range(300):
        own = np.searchsorted((centres[1:] + centres[:-1]) / 2, x, "right")
        moved = np.array([x[own == k].mean() for k in range(3)])
        done = ((moved - centres) ** 2).sum() <= 1e-4 * x.var()
        centres = moved
        if done:
            break
    got = binning.fit(long(spark, x), strategy="kmeans").first().edges
    assert np.allclose(got, [x.min(), *((centres[1:] + centres[:-1]) / 2), x.max()])


def test_value_at_a_rank(spark, monkeypatch):
    monkeypatch.setattr(sampling, "SORTED", 20)
    frame = spark.range(1000).select((F.col("id") * 7 % 503).alias("v"))
    every = sorted(k * 7 % 503 for k in range(1000))
    assert [sampling.value_at(frame, "v", r) for r in (0, 13, 500, 999)] == [every[r] for r in (0, 13, 500, 999)]
    assert sampling.value_at(frame, "v", 1000) is None and sampling.value_at(frame.limit(0), "v", 0) is None
    assert sampling.value_at(frame.select(F.lit(3).alias("v")), "v", 700) == 3


def test_ranks_within_classes(spark):
    frame = spark.range(600).select("id", F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").alias("label"))
    rows = sampling.ranked(frame, "id", by="label").collect()
    by = {}
    for r in rows:
        by.setdefault(r.label, []).append(r.rank)
        assert r.n == 200
    assert all(sorted(v) == list(range(200)) for v in by.values()) and len(by) == 3
    assert sampling.per_class(frame, "id", "label", 4).count() == 12


def test_pairs_unions_and_label_ids(spark):
    one, two = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string"), spark.createDataFrame([(2, 5), (3, 6)], "k int, y int")
    assert [(r.k, r.t, r.y) for r in sampling.paired(one, two, ["k"]).collect()] == [(2, "b", 5)]
    assert sorted((r.k, r.t, r.y) for r in sampling.concatenated(one, two).filter("k < 3").collect() if r.t) == [(1, "a", None), (2, "b", None)]
    labels = spark.createDataFrame([("b",), ("Z",), (None,), ("b",)], "l string")
    assert [(r.label, r.label_id) for r in sampling.label_ids(labels, "l").collect()] == [("Z", 0), ("b", 1)]


def test_calibrators(spark):
    with pytest.raises(ValueError, match="method"):
        calibration.Calibrator("other")
    rng = np.random.default_rng(5)
    rows = [(int(k), (rng.normal(size=3) + 3 * (np.arange(3) == k) * (rng.random() < 0.8)).tolist()) for k in rng.integers(0, 3, 300)]
    frame = spark.createDataFrame(rows, "y int, logits array<double>").withColumn("probs", calibration.softmax(F.col("logits")))
    with pytest.raises(ValueError, match="fitted"):
        calibration.Calibrator().transform(frame)
    for method in ("temperature", "isotonic"):
        made = calibration.Calibrator(method)
        out = made.fit_transform(frame)
        assert out.count() == 300 and made.params(spark).first().method == method
        assert calibration.scores(out).first().nll <= calibration.scores(frame).first().nll + (1e-6 if method == "temperature" else 1)
    model = calibration.fit_isotonic(frame)
    steps = list(zip(model.boundaries.toArray().tolist(), model.predictions.toArray().tolist(), strict=True))
    xs = [0.0, 0.4, 0.55, 0.9, 1.0]
    got = [r.v for r in spark.createDataFrame([(x,) for x in xs], "x double").select(calibration.stepped(F.col("x"), steps).alias("v")).collect()]
    assert np.allclose(got, np.interp(xs, *zip(*steps, strict=True)))
    hard = spark.createDataFrame([(1,)], "p int").select(calibration.pseudo_probabilities(F.col("p"), 4).alias("v")).first().v
    assert np.allclose(hard, np.array([0.25, 0.7, 0.25, 0.25]) / 1.45)


def recording(spark, n=512, fs=128.0, bad=None):
    rng = np.random.default_rng(7)
    t = np.arange(n) / fs
    shared = np.sin(2 * np.pi * 10 * t)
    names = ["C3", "Cz", "C4", "FC3", "FCz", "FC4", "CP3", "CPz", "CP4"]
    xyz = spectral.positions(names)
    rows = []
    for k, c in enumerate(names):
        x, y, _ = xyz[c]
        signal = shared * (1 + x) + y * np.cos(2 * np.pi * 6 * t) + 0.01 * rng.normal(size=n)
        rows.append((1, c, k, (signal * (40 if c == bad else 1)).tolist()))
    return spark.createDataFrame(rows, "trial int, channel string, ch_idx int, samples array<double>"), {r[1]: np.array(r[3]) for r in rows}


def test_splines_follow_a_smooth_field(spark):
    clips, plain = recording(spark, bad="Cz")
    clean, _ = recording(spark)
    want = {r.channel: np.array(r.samples) for r in clean.collect()}["Cz"]
    flagged = clips.withColumn("bad", F.col("channel") == "Cz")
    out = {r.channel: np.array(r.samples) for r in spectral.interpolated(flagged, "trial", spectral.positions_frame(spark, list(plain))).collect()}
    assert np.corrcoef(out["Cz"], want)[0, 1] > 0.99 and np.abs(out["Cz"] - want).max() < 0.3 and np.allclose(out["C3"], plain["C3"])
    places = np.array([spectral.positions([c])[c] for c in plain if c != "Cz"])
    w = spectral.spline_weights(places, np.array([spectral.positions(["Cz"])["Cz"]]))
    assert np.allclose(w.sum(1), 1) and np.allclose(out["Cz"], w[0] @ np.stack([v for c, v in plain.items() if c != "Cz"]))


def test_eye_components_go(spark):
    rng = np.random.default_rng(8)
    n, fs = 1024, 128.0
    t = np.arange(n) / fs
    blink = (np.sin(2 * np.pi * 2 * t) > 0.95).astype(float) * 5
    brain = [np.sin(2 * np.pi * 10 * t), np.sign(np.sin(2 * np.pi * 7 * t)), rng.laplace(size=n)]
    rows = [(1, f"c{k}", k, (sum((0.3 + ((k + j) % 3)) * b for j, b in enumerate(brain)) + (0.5 + k) * blink).tolist()) for k in range(6)] + [(1, "eye", 6, (blink * 3).tolist())]
    clips = spark.createDataFrame(rows, "trial int, channel string, ch_idx int, samples array<double>")
    out = {r.channel: np.array(r.samples) for r in spectral.without_artifacts(clips, "trial", fs, ["eye"], 4, limit=1.5).collect()}
    for k in range(1, 6):
        assert abs(np.corrcoef(out[f"c{k}"], blink)[0, 1]) < 0.3 < abs(np.corrcoef(rows[k][3], blink)[0, 1])
    assert np.allclose(out["eye"], rows[6][3])
    same = spectral.without_artifacts(clips, "trial", fs, ["none"])
    assert all(np.allclose(r.samples, rows[r.ch_idx][3]) for r in same.collect())


def test_stages_of_the_preparation(spark):
    clips, _ = recording(spark, bad="Cz")
    stages = spectral.preprocessed(clips, "trial", 128.0, 1.0, 40.0, 50.0, spectral.positions_frame(spark, [r.channel for r in clips.collect()]), ["C3"], 2.0)
    assert list(stages) == ["raw", "filtered", "interpolated", "ica_cleaned", "final"]
    last = np.stack([np.array(r.samples) for r in stages["final"].collect()])
    assert np.abs(last.sum(0)).max() < 1e-9 and stages["final"].columns == clips.columns
    assert list(spectral.preprocessed(clips, "trial", 128.0)) == ["raw", "filtered", "final"]
    # the notch takes out the mains' hum and leaves what is far from it
    t = np.arange(2048) / 256.0
    hum = spark.createDataFrame([(1, (np.sin(2 * np.pi * 50 * t) + np.sin(2 * np.pi * 10 * t)).tolist())], "id int, samples array<double>")
    power = lambda x, f: np.abs(np.fft.rfft(x)[int(f * len(x) / 256)])
    one, two = (np.array(spectral.filtered(hum, 256.0, 1.0, 100.0, n).first().samples)[512:1536] for n in (None, 50.0))
    assert power(two, 50) < 0.5 * power(one, 50) and power(two, 10) > 0.9 * power(one, 10)


def test_all_features(spark):
    clips, _ = recording(spark)
    out = spectral.all_features(clips, 128.0, "trial", ["C3", "C4", "nowhere"], include_connectivity=True, method="plv")
    assert {r.kind: r.n for r in out.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"band_power": 10, "spectral": 6, "connectivity": 1}
    assert {r.feature for r in out.filter("kind != 'band_power'").collect()} == {f"{n}_{c}" for n in ("entropy", "peak_freq", "centroid") for c in ("C3", "C4")} | {"conn_C3_C4"}
    with pytest.raises(ValueError, match="method"):
        spectral.all_features(clips, 128.0, "trial", method="pli")


def test_runs_are_read_back_and_evaluated(spark, tmp_path):
    from sigweave.plans import runs

    rng = np.random.default_rng(11)
    rows, labels = [], []
    t = np.arange(64 * 24) / 64
    for k in range(6):
        y = k % 2
        for i, c in enumerate(("C3", "C4")):
            rows.append((f"t{k}", c, i, (np.sin(2 * np.pi * (10 if y else 20) * t) * (2 + i) + 0.1 * rng.normal(size=len(t))).tolist()))
        labels.append((f"t{k}", y))
    recordings = spark.createDataFrame(rows, "trial_id string, channel string, ch_idx int, samples array<double>")
    settings = config.Config().changed(data={"segment_length": 2.0}, features={"include_spectral": True}, experiment={"calibration": "isotonic"})
    result = experiment.run(recordings, spark.createDataFrame(labels, "trial_id string, y int"), 64.0, settings, 2)
    assert result.rules.filter("feature = 'entropy_C3'").count() == 1
    path = str(tmp_path / "run1")
    runs.save(result, settings, path, ["closed", "open"])
    assert all((tmp_path / "run1" / p).is_dir() for p in ("logs", "plots", "models")) and config.Config.load(f"{path}/config.yaml") == settings
    back = runs.load(spark, path)
    assert back.args["labels"] == ["closed", "open"] and back.vocabulary.count() == result.vocabulary.count() and back.rules.count() == result.rules.count()
    test = spark.read.schema("tokens array<string>, label string").json(f"{path}/test_data.json")
    predictions, report = runs.evaluate(back, test.union(spark.createDataFrame([(["a"], "other")], test.schema)), "temperature")
    assert predictions.count() == test.count() and report.first().accuracy > 0.8 and report.first().run_id.startswith("eval_2")
    assert runs.latest(spark, str(tmp_path)).endswith("run1")
    again = runs.execute(spark, settings, str(tmp_path / "eval"), "eval", model_path=path)
    assert again.first().accuracy > 0.8
    assert runs.execute(spark, settings, str(tmp_path / "dry"), dry_run=True) is None and (tmp_path / "dry" / "config.yaml").exists()
    for bad in ({"mode": "other"}, {"mode": "eval"}):
        with pytest.raises(ValueError):
            runs.execute(spark, settings, str(tmp_path / "x"), **bad)
    spark.createDataFrame([("gpt9", 1, 2, ["a"], 3, "quantile")], runs.ARGS).coalesce(1).write.mode("overwrite").json(f"{path}/args.json")
    with pytest.raises(ValueError, match="model type"):
        runs.load(spark, path)
    assert "bins: 3" in runs.described(settings)


def test_tokenizer_artifact(spark, tmp_path):
    rules = binning.fit(long(spark, [1, 2, 3, 4]).union(long(spark, [5, 5], "flat")))
    vocab = tokens.vocabulary(spark.createDataFrame([("a",), ("b",)], "token string"))
    artifacts.save_tokenizer(rules, vocab, {"n_bins": 3, "strategy": "quantile"}, str(tmp_path / "t"))
    got_rules, got_vocab, settings = artifacts.load_tokenizer(spark, str(tmp_path / "t"))
    assert {r.feature: r.edges for r in got_rules.collect()} == {r.feature: r.edges for r in rules.collect()}
    assert sorted(map(tuple, got_vocab.collect())) == sorted(map(tuple, vocab.collect())) and settings == {"n_bins": "3", "strategy": "quantile"}


def test_subjects_keep_the_file_order(spark, tmp_path):
    (tmp_path / "participants.tsv").write_text("participant_id\tage\nsub-9\t3\nsub-1\t4\nsub-5\t5\n")
    people = bids.participants(spark, str(tmp_path))
    assert [r.subject_id for r in bids.first_subjects(people, 2).collect()] == ["sub-9", "sub-1"]


def test_special_tokens(spark):
    m = spark.range(1).select(tokens.special_tokens().alias("m")).first().m
    assert len(m) == 11 and m["PAD"] == "<PAD>" and m["3"] == "<FEET>"


def test_five_bins_lose_their_prefix_in_structured_tokens(spark):
    lists = spark.createDataFrame([(1, ["alpha_C3_VERY_HIGH"]), (2, ["alpha_C3_HIGH", "beta_C3_HIGH", "theta_C4_MEDIUM", "delta_C4_MEDIUM"])], "id long, tokens array<string>")
    out = {r.id: r.structured for r in tokens.structured(lists, "id").collect()}
    assert out[1] == ""
    assert out[2] == "[CENTRAL:beta_C3 theta_C4] [LEFT_MOTOR:beta_C3] [RIGHT_MOTOR:theta_C4]"


def test_vocabulary_and_encoding(spark):
    rows = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "b"), (2, 0, "c"), (2, 1, None)], "id long, pos int, token string")
    vocab = tokens.vocabulary(rows, 1, 9)
    assert {r.token: r.id for r in vocab.collect() if r.freq} == {"b": 7, "a": 8}
    out = {r.id: (r.input_ids, r.attention_mask) for r in tokens.encode(rows, vocab, "id", "pos", 4).collect()}
    assert out == {1: ([7, 8, 7, 0], [1, 1, 1, 0]), 2: ([1, 1, 0, 0], [1, 1, 0, 0])}


def test_sinusoid_peaks_at_its_frequency(spark):
    fs, n = 64.0, 256
    wave = np.sin(2 * np.pi * 10 * np.arange(n) / fs)
    clips = spark.createDataFrame([(1, wave.tolist()), (2, [])], "id int, samples array<double>")
    out = spectral.spectral_features(spectral.psd(clips, fs).filter("id = 1"), fs, 128, ["id"]).first()
    assert out.peak_frequency == 10.0
    power = {r.band: r.power for r in spectral.band_power(spectral.psd(clips, fs).filter("id = 1"), fs, 128, ["id"]).collect()}
    assert power["alpha"] > 100 * power["delta"]
    assert abs(sum(spectral.one_sided((np.abs(spectral.welch_segments(wave, 128, 64)) ** 2).mean(0), 128, fs)) * fs / 128 - 0.5) < 1e-6


def test_equal_channels_are_coherent_and_locked(spark):
    wave = np.random.default_rng(0).normal(size=512).tolist()
    clips = spark.createDataFrame([(1, 0, "a", wave), (1, 1, "b", wave)], "epoch int, ch_idx int, channel string, samples array<double>")
    pairs = spectral.channel_pairs(clips, "epoch")
    for method in ("coh", "plv"):
        assert abs(spectral.connectivity(pairs, 64.0, method).first().value - 1) < 1e-9
    with pytest.raises(ValueError):
        spectral.connectivity(pairs, 64.0, "pli")


def test_band_pass_keeps_the_band(spark):
    t = np.arange(1024) / 128
    clips = spark.createDataFrame([(i, np.sin(2 * np.pi * f * t).tolist()) for i, f in enumerate((10, 40))], "id int, samples array<double>")
    power = {r.id: float(np.var(r.samples[200:-200])) for r in spectral.filtered(clips, 128.0, 2.0, 20.0, None).collect()}
    assert power[0] > 0.4 and power[1] < 0.01


def test_average_reference_sums_to_zero(spark):
    clips = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [3.0, 6.0])], "epoch int, ch_idx int, samples array<double>")
    assert sorted(r.samples for r in spectral.average_reference(clips, "epoch").collect()) == [[-1.0, -2.0], [1.0, 2.0]]


def test_windows_are_full(spark):
    clips = spark.createDataFrame([(1, [float(i) for i in range(10)]), (2, [1.0])], "id int, samples array<double>")
    out = segment.sliding(clips, 4, 3).collect()
    assert [(r.id, r.start, r.samples[0]) for r in out] == [(1, 0, 0.0), (1, 3, 3.0), (1, 6, 6.0)]


def test_split_is_exact_and_disjoint(spark):
    rows = spark.range(101).withColumnRenamed("id", "k")
    counts = {r.split: r["count"] for r in sampling.split(rows, "k").groupBy("split").count().collect()}
    assert counts == {"test": 20, "val": 10, "train": 71}


def test_few_shot_holds_at_most_n_of_each_class(spark):
    rows = spark.createDataFrame([(i, i % 3 + 1, ["t"]) for i in range(20)] + [(99, 4, ["t"])], "id long, label int, tokens array<string>")
    counts = {r.label: r["count"] for r in prompts.few_shot(rows, "id", 3).groupBy("label").count().collect()}
    assert counts == {1: 3, 2: 3, 3: 3, 4: 1}


def test_argmax_takes_the_first(spark):
    assert spark.createDataFrame([([0.4, 0.4, 0.2],)], "p array<double>").select(sampling.argmax(F.col("p"))).first()[0] == 0


def test_calibration_properties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, (rng.normal(size=3) * 3 + 4 * (np.arange(3) == (i % 3 if i % 10 < 7 else (i + 1) % 3))).tolist()) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, y int, logits array<double>").withColumn("probs", calibration.softmax(F.col("logits")))
    out = calibration.calibration_summary(frame).first()
    assert out.ece <= out.mce and out.ace <= out.mce
    assert all(abs(sum(r.probs) - 1) < 1e-12 for r in frame.collect())
    t = calibration.fit_temperature(frame)
    loss = {r.temperature: r.nll for r in calibration.temperature_grid(frame, [t, t * 0.9, t * 1.1]).collect()}
    assert loss[t] <= min(loss.values()) + 1e-6
    flat = calibration.isotonic_legacy(frame, F.lit(0.0)).first().probs
    assert all(np.isnan(flat))
    assert abs(sum(calibration.isotonic_corrected(frame, F.lit(0.6)).first().probs) - 1) < 1e-9


def test_bins_are_open_below_and_closed_above(spark):
    values = [0.0, 0.1, 0.3, 0.5, 1.0]
    out = [r[0] for r in spark.createDataFrame([(v,) for v in values], "c double").select(calibration.bin_of(F.col("c"), 10)).collect()]
    edges = [i * (1 / 10) for i in range(11)]
    assert out == [next((b for b in range(10) if edges[b] < v <= edges[b + 1]), None) for v in values]


def test_absent_class_counts_zero(spark):
    frame = spark.createDataFrame([(0, 0), (0, 1)], "y int, pred int")
    out = {r["class"]: r for r in metrics.per_class(metrics.confusion(frame, 3)).collect()}
    assert out[2].f1 == 0 and out[0].recall == 0.5 and out[1].precision == 0


def test_first_seen_wins_a_tie(spark):
    votes = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "a", 2), (1, "b", 3)], "k int, v string, o int")
    assert metrics.majority(votes, "k", "v", "o").first().winner == "b"


def test_explanation_lowers_all_but_its_first_letter(spark):
    frame = spark.createDataFrame([(["Theta_X_LOW"], 3), (["beta_left_HIGH"], 2)], "tokens array<string>, label int")
    said = [r[0] for r in frame.select(prompts.explanation(F.col("tokens"), F.col("label"))).collect()]
    assert said[0] == "Eeg patterns consistent with feet motor imagery motor imagery."
    assert said[1] == "Beta band suppression in motor cortex indicates hand movement preparation. left hemisphere motor cortex activation for right hand control."


def test_confidence_rounds_half_to_even(spark):
    frame = spark.createDataFrame([(["a"], 1, 0.125)], "tokens array<string>, label int, c double")
    assert "(confidence: 0.12)" in frame.select(prompts.explanation_prompt(F.col("tokens"), F.col("label"), F.col("c"))).first()[0]


def test_truncation_leaves_room(spark):
    frame = spark.createDataFrame([([str(i) for i in range(30)],)], "tokens array<string>")
    assert frame.select(prompts.inference(F.col("tokens"), 20, False)).first()[0] == f"{dims.CLASSIFY} {' '.join(map(str, range(10)))} Prediction:"


def test_short_sequences_are_not_swapped(spark):
    frame = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["a", "b", "c", "d", "e"])], "id int, tokens array<string>")
    out = {r.id: r.t for r in frame.select("id", prompts.augmented(F.col("tokens"), "id", 1.0, soften=0.0).alias("t")).collect()}
    assert out[1] == ["a", "b", "c", "d"] and out[2] != ["a", "b", "c", "d", "e"] and sorted(out[2]) == ["a", "b", "c", "d", "e"]


def test_config(tmp_path):
    for name, made in config.presets().items():
        made.save(f"{tmp_path}/{name}.json")
        assert config.Config.load(f"{tmp_path}/{name}.json") == made
    for section, bad in (("data", {"overlap": 1.0}), ("features", {"n_bins": 1}), ("experiment", {"test_size": 0.9, "val_size": 0.2}), ("model", {"learning_rate": 0.0})):
        with pytest.raises(ValueError):
            config.Config().changed(**{section: bad})
    with pytest.raises(ValueError):
        config.Config.load(f"{tmp_path}/x.txt") if (tmp_path / "x.txt").write_text("") is not None else None


def bids_folder(root):
    (root / "sub-01/ses-session1/eeg").mkdir(parents=True)
    (root / "participants.tsv").write_text("participant_id\tage\tsex\tHeight\tWeight\nsub-01\t23\tM\t170\tn/a\nsub-02\tn/a\tf\t160\t55.5\n")
    stem = root / "sub-01/ses-session1/eeg/sub-01_ses-session1_task-memory"
    (stem.parent / f"{stem.name}_eeg.json").write_text(json.dumps({"EEGChannelCount": 2, "SamplingFrequency": 100.0, "RecordingDuration": 8.0}))
    (stem.parent / f"{stem.name}_eeg.vhdr").write_text("[Common Infos]\nNumberOfChannels=2\nSamplingInterval=10000\nDataOrientation=MULTIPLEXED\n[Binary Infos]\nBinaryFormat=INT_16\n[Channel Infos]\nCh1=C3,,0.5\nCh2=C4,,1\n")
    np.random.default_rng(0).integers(-100, 100, (800, 2)).astype("<i2").tofile(stem.parent / f"{stem.name}_eeg.eeg")
    (stem.parent / f"{stem.name}_eeg.vmrk").write_text("[Marker Infos]\nMk1=Stimulus,S  2,101,1,0\nMk2=Stimulus,S  3,201,1,0\n")
    (stem.parent / "bad_eeg.vhdr").write_text("nothing")
    (stem.parent / "bad_eeg.eeg").write_bytes(b"")


def test_bids_and_experiment(spark, tmp_path):
    bids_folder(tmp_path)
    root = str(tmp_path)
    people = {r.subject_id: r for r in bids.participants(spark, root).collect()}
    assert people["sub-01"].weight is None and people["sub-01"].sex == "m" and people["sub-02"].age is None
    assert bids.participants(spark, root, ["sub-02"]).count() == 1 and bids.participants(spark, root, []).count() == 2
    info = bids.dataset_info(spark, root).first()
    assert (info.n_subjects, info.n_channels, info.tasks) == (2, 2, ["memory"])
    assert bids.grid(bids.participants(spark, root), bids.SESSIONS, dims.TASKS).count() == 30
    rows = bids.recordings(spark, root)
    assert rows.filter("error is not null").count() == 1
    good = rows.filter("error is null")
    assert {(r.channel, r.fs, len(r.samples)) for r in good.collect()} == {("C3", 100.0, 800), ("C4", 100.0, 800)}
    assert {(r.sample_idx, r.event_id) for r in bids.markers(spark, root).collect()} == {(101, 2), (201, 3)}
    many = good.select("trial_id", "channel", "ch_idx", "samples").crossJoin(spark.range(6).select(F.col("id").alias("k"))).withColumn("trial_id", F.concat_ws("-", "trial_id", "k"))
    labels = many.select("trial_id", (F.col("k") % 2).cast("int").alias("y")).distinct()
    out = experiment.run(many, labels, 100.0, config.Config().changed(data={"segment_length": 1.0}, model={"max_length": 16}), 2)
    assert 0 <= out.report.first().accuracy <= 1
    artifacts.save_rules(out.rules, f"{root}/rules")
    assert artifacts.load_rules(spark, f"{root}/rules").count() == out.rules.count()
    artifacts.save_report(out.report, f"{root}/report")


def test_artifacts(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"token_sequences": [["a"], ["b", "c"], ["d"]], "labels": ["x", "y"]}))
    assert [(r.tokens, r.label) for r in artifacts.load_test_data(spark, f"{tmp_path}/t.json").orderBy("idx").collect()] == [(["a"], "x"), (["b", "c"], "y")]
    with pytest.raises(ValueError):
        artifacts.load_test_data(spark, "t.csv")
    rules = binning.fit(long(spark, [1, 1]))
    artifacts.save_rules(rules, f"{tmp_path}/rules")
    assert artifacts.load_rules(spark, f"{tmp_path}/rules").first().edges == [float("-inf"), float("inf")]


def test_streamed_tokens_equal_batch_tokens(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.write.parquet(f"{tmp_path}/in")
    rules = binning.fit(binning.unpivoted(events.withColumn("feature", F.col("event_type")), ["value"], []).withColumn("feature", F.lit("value")))
    named = lambda df: df.withColumn("feature_name", F.lit("value"))
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    out = tokenize.windowed_counts(tokenize.tokenized(named(stream), rules, "feature_name", "value"), "ts", "1 day", "1 day")
    query = out.writeStream.format("memory").queryName("streamed").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    batch = tokenize.tokenized(named(events), rules, "feature_name", "value").groupBy(F.window("ts", "1 day", "1 day").alias("window"), "token").agg(F.count("*").alias("n"))
    assert sorted(map(str, spark.table("streamed").collect())) == sorted(map(str, batch.select("window", "token", "n").collect()))
