"""Runs on disk: what an experiment leaves, read back for evaluation; modes and the command line.

A run is a folder: config.yaml, logs/, plots/, models/, args.json, vocabulary.json,
binning_rules.json, test_data.json, report.json, predictions.json and
calibration_params.json. All but the first two are written by Spark.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.operators import calibration
from sigweave.plans import classifiers, experiment
from sigweave.plans.config import Config, presets
from sigweave.sources import artifacts, bids

MODES = ("train", "eval", "full")
ARGS = "model_type string, max_length int, n_classes int, labels array<string>, n_bins int, strategy string"
log = logging.getLogger("sigweave")


def prepare(config: Config, path: str) -> Path:
    """The run's folder with its parts and a snapshot of the configuration."""
    root = Path(path)
    for part in ("logs", "plots", "models"):
        (root / part).mkdir(parents=True, exist_ok=True)
    config.save(str(root / "config.yaml"))
    return root


def start_logging(level: str = "INFO", folder: str | None = None) -> None:
    """Messages go to the console, and to run.log in the folder if there is one."""
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if folder:
        handlers.append(logging.FileHandler(Path(folder) / "run.log"))
    logging.basicConfig(level=level, format="%(asctime)s %(name)s %(levelname)s %(message)s", handlers=handlers, force=True)


def described(config: Config) -> str:
    """A summary of a configuration, one setting to a line."""
    e, d, f, m = config.experiment, config.data, config.features, config.model
    lines = {"experiment": e.experiment_name, "model": m.model_type, "subjects": d.n_subjects or "all", "tasks": ", ".join(d.tasks), "segment": f"{d.segment_length} s, overlap {d.overlap}", "bins": f"{f.n_bins} ({f.binning_strategy})", "epochs": m.epochs, "learning rate": m.learning_rate, "seed": e.seed}
    return "\n".join(f"{k}: {v}" for k, v in lines.items())


def save(result: experiment.Result, config: Config, path: str, labels: list[str]) -> None:
    """Writes everything that an evaluation needs, and the training report."""
    root = prepare(config, path)
    spark = result.report.sparkSession
    args = (config.model.model_type, config.model.max_length, len(labels), labels, config.features.n_bins, config.features.binning_strategy)
    spark.createDataFrame([args], ARGS).coalesce(1).write.mode("overwrite").json(f"{root}/args.json")
    artifacts.save_vocabulary(result.vocabulary, f"{root}/vocabulary.json")
    artifacts.save_rules(result.rules, f"{root}/binning_rules.json")
    result.model.save(f"{root}/models")
    artifacts.save_report(result.report, f"{root}/report.json")
    artifacts.save_predictions(result.predictions, f"{root}/predictions.json")
    if result.calibrator:
        artifacts.save_report(result.calibrator.params(spark), f"{root}/calibration_params.json")
    names = F.array(*map(F.lit, labels))
    result.lists.filter("split = 'test'").select("tokens", F.get(names, F.col("y").cast("int")).alias("label")).write.mode("overwrite").json(f"{root}/test_data.json")


@dataclass
class Run:
    args: dict
    vocabulary: DataFrame
    rules: DataFrame
    model: classifiers.Classifier


def load(spark: SparkSession, path: str) -> Run:
    """Arguments, vocabulary, rules and model of a run; an unknown kind of model is an error."""
    args = spark.read.schema(ARGS).json(f"{path}/args.json").first().asDict()
    vocabulary = artifacts.load_vocabulary(spark, f"{path}/vocabulary.json")
    model = classifiers.load(args["model_type"], f"{path}/models", vocabulary)
    return Run(args, vocabulary, artifacts.load_rules(spark, f"{path}/binning_rules.json"), model)


def evaluate(run: Run, test: DataFrame, method: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(predictions, report) of rows (tokens, label); labels that the run doesn't know are left out of both. `method` calibrates on these rows."""
    names = run.args["labels"]
    y = F.array_position(F.array(*map(F.lit, names)), F.col("label")) - 1
    rows = test.withColumn("y", y.cast("int")).filter("y >= 0")
    out = experiment.predicted(run.model, rows, ["tokens", "label", "y"])
    if method:
        out = calibration.Calibrator(method).fit_transform(out)
    report = experiment.measured(out, len(names)).withColumns({"model_type": F.lit(run.args["model_type"]), "dataset_split": F.lit("test"), "run_id": F.concat(F.lit("eval_"), F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss"))})
    return calibration.decided(out, names), report


def latest(spark: SparkSession, root: str) -> str | None:
    """The run folder under `root` whose args.json was written last; None without any."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root).drop("content")
    found = files.withColumn("run", F.regexp_extract("path", r"^(.*)/args\.json/", 1)).filter("run != ''").agg(F.max_by("run", F.struct("modificationTime", "run"))).first()[0]
    return found


def execute(spark: SparkSession, config: Config, path: str, mode: str = "full", source: str | None = None, model_path: str | None = None, dry_run: bool = False, test_data: str | None = None) -> DataFrame | None:
    """Trains on the BIDS folder `source`, evaluates a run, or both; returns the last report. A dry run only saves the configuration. `test_data` is evaluated on in place of what the run has kept."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "eval" and not model_path:
        raise ValueError("evaluation needs the path of a run")
    prepare(config, path)
    if dry_run:
        return None
    report = None
    if mode != "eval":
        people = bids.participants(spark, source)
        people = bids.first_subjects(people, config.data.n_subjects) if config.data.n_subjects else people
        wanted = bids.grid(people, list(config.data.sessions), list(config.data.tasks))
        labels = wanted.select("trial_id", (F.array_position(F.array(*map(F.lit, config.data.tasks)), F.col("task")) - 1).cast("int").alias("y"))
        rows = bids.recordings(spark, source).filter("error is null").join(labels.select("trial_id"), "trial_id", "left_semi").persist()
        try:
            fs = rows.agg(F.max("fs")).first()[0]
            if fs is None:
                raise ValueError("no recording could be read")
            result = experiment.run(rows, labels, fs, config, len(config.data.tasks))
            save(result, config, path, list(config.data.tasks))
            report = spark.read.json(f"{path}/report.json")
        finally:
            rows.unpersist()
        log.info("trained: %s", path)
    if mode != "train":
        run = load(spark, model_path or path)
        test = artifacts.load_test_data(spark, test_data).select("tokens", "label") if test_data else spark.read.schema("tokens array<string>, label string").json(f"{model_path or path}/test_data.json")
        predictions, report = evaluate(run, test, None if config.experiment.calibration == "none" else config.experiment.calibration)
        artifacts.save_predictions(predictions, f"{path}/eval_predictions.json")
        artifacts.save_report(report, f"{path}/eval_report.json")
        report = spark.read.json(f"{path}/eval_report.json")
        log.info("evaluated: %s", model_path or path)
    return report


#: Settings that the command line may replace: section, field, type.
OVERRIDES = {"epochs": ("model", int), "batch_size": ("model", int), "learning_rate": ("model", float), "n_subjects": ("data", int), "output_dir": ("experiment", str), "run_name": ("experiment", str)}


def overridden(config: Config, values: dict) -> Config:
    """The configuration with the settings of OVERRIDES that have a value, checked like any other."""
    sections: dict[str, dict] = {}
    for name, (section, _) in OVERRIDES.items():
        if values.get(name) is not None:
            sections.setdefault(section, {})[name] = values[name]
    if "batch_size" in sections.get("model", {}):
        sections["model"]["eval_batch_size"] = None
    return config.changed(**sections)


def parsed(argv: list[str] | None = None) -> argparse.Namespace:
    """The command line; an option's words may be joined by dashes or underscores."""
    parser = argparse.ArgumentParser(description="Train and evaluate on a BIDS folder")

    def option(name: str, **more: object) -> None:
        parser.add_argument(*dict.fromkeys((f"--{name.replace('_', '-')}", f"--{name}")), dest=name, **more)

    parser.add_argument("--preset", "--config", choices=sorted(presets()), default="quick_test")
    option("config_file", help="a YAML or JSON file instead of a preset")
    option("mode", choices=MODES, default="full")
    option("source")
    option("output", help="the run's folder; by default the run's name in the output directory")
    option("model_path")
    option("test_data_path", help="a JSON file of token sequences and labels to evaluate on")
    option("log_level", default="INFO")
    option("dry_run", action="store_true")
    for name, (_, kind) in OVERRIDES.items():
        option(name, type=kind)
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    """The command line: a preset or a file of settings, settings that replace its own, a mode, and folders."""
    args = parsed(argv)
    config = Config.load(args.config_file) if args.config_file else presets()[args.preset]
    config = overridden(config, vars(args)).named()
    path = args.output or f"{config.experiment.output_dir}/{config.experiment.run_name}"
    prepare(config, path)
    start_logging(args.log_level, f"{path}/logs")
    log.info(described(config))
    execute(SparkSession.builder.getOrCreate(), config, path, args.mode, args.source, args.model_path, args.dry_run, args.test_data_path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
