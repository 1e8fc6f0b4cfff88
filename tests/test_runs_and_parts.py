"""Command-line settings, varied training rows, epochs by configuration, filters over parts, JSON columns and artifacts."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigweave.operators import segment, spectral
from sigweave.plans import config, experiment, queries, runs
from sigweave.sources import artifacts, variants


def test_settings_of_the_command_line(tmp_path):
    args = runs.parsed(["--config", "llm_fine", "--epochs", "7", "--batch_size", "9", "--learning-rate", "0.5", "--n_subjects", "2", "--output_dir", str(tmp_path), "--dry_run"])
    made = runs.overridden(config.presets()[args.preset], vars(args))
    assert (made.model.epochs, made.model.batch_size, made.model.eval_batch_size, made.model.learning_rate, made.data.n_subjects, made.features.n_bins) == (7, 9, 18, 0.5, 2, 5)
    assert made.named(datetime(2024, 3, 1, 12, 5, 9)).experiment.run_name == "llm_fine_binning_20240301_120509"
    assert runs.overridden(made, {"run_name": "mine"}).named().experiment.run_name == "mine"
    with pytest.raises(ValueError, match="learning_rate"):
        runs.overridden(made, {"learning_rate": -1.0})
    with pytest.raises(SystemExit):
        runs.parsed(["--mode", "other"])


def test_run_is_named_and_placed(spark, tmp_path):
    assert runs.main(["--config", "quick_test", "--output-dir", str(tmp_path), "--run-name", "r1", "--epochs", "3", "--dry-run"]) == 0
    assert config.Config.load(f"{tmp_path}/r1/config.yaml").model.epochs == 3
    assert runs.main(["--config", "quick_test", "--output-dir", str(tmp_path), "--dry-run"]) == 0
    assert sum(p.name.startswith("quick_test_2") for p in tmp_path.iterdir()) == 1


def test_generator_varies_training_rows(spark):
    rows = spark.createDataFrame([(str(i), ["a_HIGH", "b_LOW", "c", "d", "e", "f"], i % 2) for i in range(40)], "window_id string, tokens array<string>, y int")
    settings = config.Config().changed(generator={"probability": 1.0, "copies": 2})
    out = experiment.with_variations(rows, "window_id", settings).collect()
    assert len(out) == 120 and sum(r.tokens == ["a_HIGH", "b_LOW", "c", "d", "e", "f"] for r in out) < 60
    assert experiment.with_variations(rows, "window_id", config.Config()).count() == 40


def test_segmenter_cuts_epochs(spark):
    samples = spark.createDataFrame([("r", c, float(t), float(10 * k + t)) for k, c in enumerate("ab") for t in range(20)], "rec string, channel string, t double, v double")
    markers = spark.createDataFrame([("r", 1, 10.0)], "rec string, marker_id int, at double")
    cut = config.Config().changed(segmenter={"tmin": -2.0, "tmax": 1.0, "baseline": (-2.0, 0.0)})
    got = {(r.channel, r.rel): r.v for r in experiment.event_epochs(samples, markers, "rec", ["marker_id", "channel"], cut).collect()}
    assert got == {(c, float(k)): float(k + 1) for c in "ab" for k in (-2, -1, 0, 1)}
    plain = experiment.event_epochs(samples, markers, "rec", ["marker_id", "channel"], cut.changed(segmenter={"baseline": None}))
    assert {(r.channel, r.rel, r.v) for r in plain.filter("channel = 'a'").collect()} == {("a", float(k), float(10 + k)) for k in (-2, -1, 0, 1)}


def test_epoch_table_names_columns(spark):
    rows = spark.createDataFrame([(1, "Cz", 0.0, 5.0, 2), (1, "Cz", 0.1, 6.0, 2), (2, "C3", 0.1, 7.0, 3)], "e int, c string, rel double, v double, y int")
    out = segment.epoch_table(rows, "e", "c", "rel", "v", "y", ["Cz", "C3"], [0.0, 0.1])
    assert out.columns == ["e", "Cz_0.000s", "Cz_0.100s", "C3_0.000s", "C3_0.100s", "label"]
    assert sorted(map(tuple, out.collect())) == [(1, 5.0, 6.0, None, None, 2), (2, None, None, None, 7.0, 3)]
    with pytest.raises(ValueError):
        segment.epoch_table(rows, "e", "c", "rel", "v", "y", ["Cz"] * 200, [0.0] * 100)


def reflected(x, h):
    return np.convolve(np.pad(x, len(h) // 2, mode="reflect"), h, "valid")


def test_filter_over_parts_equals_the_whole(spark):
    """Fifty minutes at 500 Hz in parts of 65,536 samples, and short, odd and tiny recordings in parts of 700."""
    pick = np.random.default_rng(0)
    long = pick.normal(size=1_500_000)
    parts = spark.createDataFrame([("long", k, long[at : at + 65_536].tolist()) for k, at in enumerate(range(0, len(long), 65_536))], "rec string, part int, v array<double>")
    got = np.concatenate([r.v for r in spectral.filtered_parts(parts, ["rec"], 500.0, 0.5, 40.0, 50.0).orderBy("part").collect()])
    want = long
    for h in spectral.filter_taps(500.0, 0.5, 40.0, 50.0, spectral.taps_wanted(500.0, 0.5)):
        want = spectral.convolved(np.pad(want, len(h) // 2, mode="reflect"), h)
    assert np.abs(got - want).max() < 1e-9
    direct = reflected(long[:20_000], spectral.filter_taps(500.0, 0.5, 40.0, None, 3301)[0])
    assert np.abs(spectral.convolved(np.pad(long[:20_000], 1650, mode="reflect"), spectral.filter_taps(500.0, 0.5, 40.0, None, 3301)[0]) - direct).max() < 1e-9
    series = {f"n{n}": pick.normal(size=n) for n in (1, 2, 3, 50, 699, 700, 701, 1400, 1401, 2000, 2101, 3500, 5000)}
    clips = spark.createDataFrame([(k, v.tolist()) for k, v in series.items()], "rec string, samples array<double>")
    whole = {r.rec: r.samples for r in spectral.filtered(clips, 100.0, 0.5, 40.0, 20.0).collect()}
    small = spectral.filtered_parts(spectral.sample_parts(clips, ["rec"], width=100), ["rec"], 100.0, 0.5, 40.0, 20.0)
    small = {r.rec: r.samples for r in spectral.joined_parts(small, ["rec"], "samples").collect()}
    assert all(np.allclose(small[k], whole[k], atol=1e-9) and len(small[k]) == len(series[k]) for k in series)
    assert all(np.allclose(whole[k], reflected(reflected(series[k], spectral.filter_taps(100.0, 0.5, 40.0, 20.0, n)[0]), spectral.filter_taps(100.0, 0.5, 40.0, 20.0, n)[1]), atol=1e-9) for k in ("n699", "n5000") for n in [min(661, 2 * ((len(series[k]) - 1) // 2) + 1)])


def test_variants(spark):
    rows = spark.createDataFrame([('{"k": 1, "a": [{"b": "x"}]}',), ('{"k": "2"}',), ('{"k": tru',), (None,), ("null",), ('{"k": {"z": 1}}',), ("",)], "props string")
    out = variants.fields(variants.parsed(rows, "props"), "variant", {"k": ("$.k", "bigint"), "b": ("$.a[0].b", "string")}).collect()
    assert [r.malformed for r in out] == [False, False, True, None, False, False, True]
    assert [r.k for r in out] == [1, 2, None, None, None, None, None] and [r.b for r in out][:2] == ["x", None]
    found = variants.schema_found(variants.parsed(rows.limit(2), "props"), "variant").first().schema
    assert "a: ARRAY" in found and "k: " in found


def test_split_reads_its_folder_alone(spark, sf_dir, tmp_path):
    artifacts.save_splits(spark.range(10).withColumn("split", F.when(F.col("id") < 3, "test").otherwise("train")), str(tmp_path / "s"))
    some = artifacts.load_split(spark, str(tmp_path / "s"), "test")
    assert some.count() == 3 and len(some.inputFiles()) >= 1
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    assert queries.stored_split(spark, sf_dir).filter("split != 'test'").count() == 0
