"""Configuration of an experiment: frozen sections, checked when made, saved as JSON or YAML."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from datetime import datetime
from pathlib import Path

from sigweave import dims


def check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class Data:
    n_subjects: int | None = None
    sessions: tuple[str, ...] = ("session1", "session2", "session3")
    tasks: tuple[str, ...] = tuple(dims.TASKS)
    segment_length: float = 4.0
    overlap: float = 0.5
    low_freq: float = 1.0
    high_freq: float = 40.0
    notch_freq: float | None = 50.0

    def __post_init__(self) -> None:
        check(0 <= self.overlap < 1, "overlap must be in [0, 1)")
        check(self.n_subjects is None or self.n_subjects > 0, "n_subjects must be positive")
        check(self.segment_length > 0, "segment_length must be positive")


@dataclass(frozen=True)
class Features:
    n_bins: int = 3
    binning_strategy: str = "quantile"
    include_spectral: bool = False
    min_frequency: int = 1
    max_vocab_size: int = 10_000
    fit_on: str = "train"

    def __post_init__(self) -> None:
        check(self.n_bins >= 2, "n_bins must be 2 or more")
        check(self.fit_on in ("train", "all"), "fit_on is train or all")


@dataclass(frozen=True)
class Model:
    model_type: str = "llm"
    max_length: int = 512
    lora_r: int = 8
    lora_alpha: int = 16
    learning_rate: float = 2e-4
    batch_size: int = 4
    eval_batch_size: int | None = None
    epochs: int = 3
    seed: int = 42

    def __post_init__(self) -> None:
        check(self.learning_rate > 0, "learning_rate must be positive")
        check(self.model_type in ("llm", "cnn", "svm"), "unknown model_type")
        if self.eval_batch_size is None:
            object.__setattr__(self, "eval_batch_size", 2 * self.batch_size)


@dataclass(frozen=True)
class Experiment:
    experiment_name: str = "default"
    description: str = ""
    test_size: float = 0.2
    val_size: float = 0.1
    calibration: str = "temperature"
    seed: int = 42
    output_dir: str = "outputs"
    run_name: str | None = None

    def __post_init__(self) -> None:
        check(0 < self.test_size < 1 and 0 < self.val_size < 1, "split sizes must be in (0, 1)")
        check(self.test_size + self.val_size < 1, "splits must leave something to train on")
        check(self.calibration in ("temperature", "isotonic", "none"), "unknown calibration")


@dataclass(frozen=True)
class Generator:
    """How token sequences of the training part are varied: `copies` varied ones of each; noise_level is kept and used by nothing."""

    probability: float = 0.1
    copies: int = 0
    noise_level: float = 0.05
    seed: int = 42

    def __post_init__(self) -> None:
        check(0 <= self.probability <= 1, "probability must be in [0, 1]")
        check(self.copies >= 0, "copies can't be negative")


@dataclass(frozen=True)
class Segmenter:
    """Seconds about an event, the span that its baseline is taken from, and the peak-to-peak limits by kind of channel."""

    tmin: float = -1.0
    tmax: float = 4.0
    baseline: tuple[float, float] | None = (-1.0, 0.0)
    reject: dict[str, float] = field(default_factory=lambda: dict(dims.REJECT))

    def __post_init__(self) -> None:
        check(self.tmin < self.tmax, "tmin must lie before tmax")
        check(all(v > 0 for v in self.reject.values()), "limits of rejection must be positive")


@dataclass(frozen=True)
class Config:
    data: Data = field(default_factory=Data)
    features: Features = field(default_factory=Features)
    model: Model = field(default_factory=Model)
    experiment: Experiment = field(default_factory=Experiment)
    generator: Generator = field(default_factory=Generator)
    segmenter: Segmenter = field(default_factory=Segmenter)
    version: str = "1.0"

    def changed(self, **sections: dict) -> Config:
        """A copy with some fields of some sections changed."""
        return replace(self, **{k: replace(getattr(self, k), **v) for k, v in sections.items()})

    def named(self, now: datetime | None = None) -> Config:
        """The configuration with a run's name: its own, or the experiment's with the time."""
        if self.experiment.run_name:
            return self
        stamp = (now or datetime.now()).strftime("%Y%m%d_%H%M%S")
        return self.changed(experiment={"run_name": f"{self.experiment.experiment_name}_{stamp}"})

    def save(self, path: str) -> None:
        said = asdict(self)
        if Path(path).suffix in (".yaml", ".yml"):
            import yaml

            Path(path).write_text(yaml.safe_dump(json.loads(json.dumps(said)), sort_keys=False))
        elif Path(path).suffix == ".json":
            Path(path).write_text(json.dumps(said, indent=2))
        else:
            raise ValueError(f"unknown kind of file: {path}")

    @classmethod
    def load(cls, path: str) -> Config:
        text = Path(path).read_text()
        if Path(path).suffix in (".yaml", ".yml"):
            import yaml

            said = yaml.safe_load(text)
        elif Path(path).suffix == ".json":
            said = json.loads(text)
        else:
            raise ValueError(f"unknown kind of file: {path}")
        kinds = {"data": Data, "features": Features, "model": Model, "experiment": Experiment, "generator": Generator, "segmenter": Segmenter}
        made = {}
        for name, kind in kinds.items():
            known = {f.name for f in fields(kind)}
            made[name] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in said.get(name, {}).items() if k in known})
        return cls(**made, version=said.get("version", "1.0"))


def presets() -> dict[str, Config]:
    base = Config()
    named = lambda name, text, **more: base.changed(**{**more, "experiment": {"experiment_name": name, "description": text}})
    return {
        "llm_default": base,
        "llm_aggressive": named("llm_aggressive_lora", "higher rank adapters", model={"lora_r": 16, "lora_alpha": 32}),
        "llm_long": named("llm_long_sequences", "longer sequences", model={"max_length": 1024}, features={"max_vocab_size": 15_000}),
        "llm_fine": named("llm_fine_binning", "finer discretization", features={"n_bins": 5}),
        "cnn_baseline": named("cnn_baseline", "convolutional baseline", model={"model_type": "cnn"}),
        "svm_baseline": named("svm_baseline", "kernel baseline", model={"model_type": "svm"}),
        "quick_test": named("quick_test", "small and quick", data={"n_subjects": 3, "tasks": ("memory", "mathematic")}, model={"epochs": 2}),
    }
