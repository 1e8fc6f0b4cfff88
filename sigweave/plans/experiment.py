"""An experiment over recordings: windows, features, bins, tokens, splits, a classifier, calibration and a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.operators import binning, calibration, metrics, prompts, sampling, segment, spectral, tokens
from sigweave.plans import classifiers
from sigweave.plans.config import Config


def window_features(recordings: DataFrame, fs: float, config: Config) -> DataFrame:
    """window_id, feature, f_idx, value of rows (trial_id, channel, ch_idx, samples): log band powers of full windows, and spectral features if the config says so."""
    length = int(config.data.segment_length * fs)
    step = max(1, int(length * (1 - config.data.overlap)))
    clips = segment.sliding(recordings.select("trial_id", "channel", "ch_idx", "samples"), length, step)
    clips = clips.withColumn("window_id", F.concat_ws("#", "trial_id", "window_idx"))
    found = spectral.all_features(clips, fs, "window_id", include_spectral=config.features.include_spectral, normalize=False, nperseg=min(int(2 * fs), length))
    value = F.when(F.col("kind") == "band_power", F.log1p("value")).otherwise(F.col("value"))
    return found.select("window_id", "feature", "f_idx", value.alias("value"))


def predicted(model: classifiers.Classifier, lists: DataFrame, keep: list[str | Column]) -> DataFrame:
    """keep..., logits, probs of rows with tokens."""
    return model.logits(lists).select(*keep, "logits").withColumn("probs", calibration.softmax(F.col("logits")))


def measured(predictions: DataFrame, n_classes: int) -> DataFrame:
    """One row: accuracy, F1 and calibration measures of labelled predictions."""
    decided = calibration.decided(predictions, [str(k) for k in range(n_classes)])
    scores = metrics.summary(metrics.per_class(metrics.confusion(decided, n_classes)))
    return scores.crossJoin(calibration.calibration_summary(predictions))


def event_epochs(samples: DataFrame, markers: DataFrame, key: str, by: list[str], config: Config, channel: str = "channel", kind: str | None = None) -> DataFrame:
    """Samples (key, t, v) about markers (key, marker_id, at) within the configuration's span, less the mean of its baseline if it names one; `by` tells epochs and channels apart.

    If the samples say their channel's kind, epochs over the configuration's limits go.
    """
    cut = config.segmenter
    rows = segment.epochs(samples, markers, key, cut.tmin, cut.tmax)
    if kind:
        rows = segment.kept_by_kind(rows, [c for c in by if c != channel], channel, kind, cut.reject)
    return segment.baseline_corrected(rows, by, *cut.baseline) if cut.baseline else rows


def with_variations(lists: DataFrame, key: str, config: Config) -> DataFrame:
    """The rows (key, tokens, others) and as many varied copies of each as the configuration says."""
    how = config.generator
    out = lists
    for k in range(how.copies):
        out = out.unionByName(lists.withColumn("tokens", prompts.augmented(F.col("tokens"), key, how.probability, seed=how.seed + k)))
    return out


@dataclass
class Result:
    rules: DataFrame
    vocabulary: DataFrame
    encoded: DataFrame
    predictions: DataFrame
    report: DataFrame
    model: classifiers.Classifier
    calibrator: calibration.Calibrator | None
    #: window_id, split, y, tokens.
    lists: DataFrame


def run(recordings: DataFrame, labels: DataFrame, fs: float, config: Config, n_classes: int) -> Result:
    """`labels` has trial_id, y (0 to n_classes - 1). Rules and vocabulary are fitted on the training part unless the config says all."""
    features = window_features(recordings, fs, config)
    ids = features.select("window_id").distinct().withColumn("trial_id", F.regexp_extract("window_id", r"^(.*)#", 1)).join(labels, "trial_id")
    parts = sampling.split(ids, "window_id", config.experiment.test_size, config.experiment.val_size, config.experiment.seed)
    long = features.join(parts.select("window_id", "split"), "window_id")
    source = long.filter("split = 'train'") if config.features.fit_on == "train" else long
    rules = binning.fit(source, config.features.n_bins, config.features.binning_strategy)
    rows = binning.transform(long, rules).withColumn("token", tokens.token(F.col("feature"), F.col("level")))
    vocab = tokens.vocabulary(rows.filter("split = 'train'").select("token") if config.features.fit_on == "train" else rows.select("token"), config.features.min_frequency, config.features.max_vocab_size)
    encoded = tokens.encode(rows.select("window_id", "f_idx", "token"), vocab, "window_id", "f_idx", config.model.max_length)
    lists = rows.groupBy("window_id").agg(tokens.ordered("token", "f_idx").alias("tokens")).join(parts, "window_id")
    model = classifiers.fit(with_variations(lists.filter("split = 'train'"), "window_id", config), vocab, config, n_classes)
    out = predicted(model, lists, ["window_id", "split", F.col("y").cast("int").alias("y")])
    calibrator = None
    if config.experiment.calibration != "none":
        calibrator = calibration.Calibrator(config.experiment.calibration).fit(out.filter("split = 'val'"))
        out = calibrator.transform(out)
    report = measured(out.filter("split = 'test'"), n_classes)
    report = report.withColumns({"temperature": F.lit(calibrator.temperature if calibrator else None).cast("double"), "experiment": F.lit(config.experiment.experiment_name), "model_type": F.lit(config.model.model_type), "timestamp": F.current_timestamp()})
    return Result(rules, vocab, encoded, out, report, model, calibrator, lists.select("window_id", "split", "y", "tokens"))
