"""BrainVision recordings as a data source of Spark: a partition is a range of bytes of one recording.

Headers are small and are read where the scan is planned; of the data file only its length
is asked for there. A task opens its recording at its range, which is cut between
samples, so a recording of any length is never in one task or one row. Filters on the
recording and its parts, and on channels, are taken over: others are never opened.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "trial_id string, subject string, session string, task string, channel string, ch_idx int, fs double, start bigint, samples array<double>, error string"
ARROW = pa.schema([
    ("trial_id", pa.string()), ("subject", pa.string()), ("session", pa.string()), ("task", pa.string()), ("channel", pa.string()),
    ("ch_idx", pa.int32()), ("fs", pa.float64()), ("start", pa.int64()), ("samples", pa.list_(pa.float64())), ("error", pa.string()),
])
#: Types of numbers as headers name them.
FORMATS = {"INT_16": "<i2", "INT_32": "<i4", "IEEE_FLOAT_32": "<f4"}
#: Bytes of a data file that one task reads, and samples of a channel that one row holds.
PART_BYTES, ROW_SAMPLES = 64 << 20, 1 << 18
#: Columns whose filters are taken over.
BY_RECORDING, BY_CHANNEL = ("trial_id", "subject", "session", "task"), ("channel", "ch_idx")


def sections(text: str) -> dict[str, dict[str, str]]:
    """Sections of a BrainVision header or marker file."""
    out: dict[str, dict[str, str]] = {}
    section = ""
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("[") and line.endswith("]"):
            section = line[1:-1]
        elif "=" in line and not line.startswith(";"):
            k, v = line.split("=", 1)
            out.setdefault(section, {})[k.strip()] = v.strip()
    return out


@dataclass(frozen=True)
class Layout:
    """What a header says: rate, type of numbers, whether a sample's channels stand together, and (name, scale) of each channel."""

    fs: float
    kind: str
    multiplexed: bool
    channels: tuple[tuple[str, float], ...]

    @classmethod
    def of(cls, text: str) -> Layout:
        said = sections(text)
        common, found = said["Common Infos"], []
        for k in range(int(common["NumberOfChannels"])):
            name, _, scale, *_ = [*said["Channel Infos"][f"Ch{k + 1}"].split(","), "", "", ""]
            found.append((name, float(scale or 1)))
        if not found:
            raise ValueError("no channels")
        kind = FORMATS[said.get("Binary Infos", {}).get("BinaryFormat", "INT_16")]
        return cls(1e6 / float(common["SamplingInterval"]), kind, common.get("DataOrientation", "MULTIPLEXED") == "MULTIPLEXED", tuple(found))

    @property
    def width(self) -> int:
        return np.dtype(self.kind).itemsize


def names_of(path: str) -> dict[str, str | None]:
    """trial_id, subject, session and task of a file's name."""
    trial = path.rsplit("/", 1)[-1].rsplit(".", 1)[0].removesuffix("_eeg")
    parts = dict(p.split("-", 1) for p in trial.split("_") if "-" in p)
    return {"trial_id": trial, "subject": parts.get("sub"), "session": parts.get("ses"), "task": parts.get("task")}


@dataclass
class Part(InputPartition):
    """Samples `first` to `last` of a recording, of the channels in `channels`; or what was wrong with it."""

    path: str
    layout: Layout | None
    total: int
    first: int
    last: int
    channels: tuple[int, ...]
    error: str | None = None


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Reader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int) -> None:
        self.path, self.part_bytes = path, part_bytes
        self.wanted: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            values = (f.value,) if isinstance(f, EqualTo) else tuple(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in BY_RECORDING + BY_CHANNEL:
                self.wanted.append((f.attribute[0], values))
            else:
                yield f

    def _lets_through(self, named: dict) -> bool:
        return all(named[c] in values for c, values in self.wanted if c in named)

    def partitions(self) -> list[Part]:
        store, root = opened(self.path)
        out: list[Part] = []
        for info in store.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)):
            if not info.path.endswith(".vhdr") or not self._lets_through(names_of(info.path)):
                continue
            data = info.path.removesuffix(".vhdr") + ".eeg"
            try:
                with store.open_input_file(info.path) as f:
                    layout = Layout.of(f.read().decode("utf-8", "replace"))
                size = store.get_file_info(data)
                if size.type != pyarrow.fs.FileType.File:
                    raise FileNotFoundError("no data")
                total = size.size // (layout.width * len(layout.channels))
                named = [{"channel": n, "ch_idx": k} for k, (n, _) in enumerate(layout.channels)]
                kept = tuple(k for k, n in enumerate(named) if self._lets_through(n))
                if not kept:
                    continue
                # of channels that stand apart only those asked for are read
                step = max(1, self.part_bytes // (layout.width * (len(layout.channels) if layout.multiplexed else len(kept))))
                out += [Part(data, layout, total, at, min(at + step, total), kept) for at in range(0, max(total, 1), step)]
            except Exception as e:  # noqa: BLE001  a recording that can't be read is reported as data
                # what is wrong with a recording belongs to no channel
                if not any(c in BY_CHANNEL for c, _ in self.wanted):
                    out.append(Part(data, None, 0, 0, 0, (), f"{type(e).__name__}: {e}"))
        return out or [Part("", None, 0, 0, 0, ())]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        named = names_of(partition.path)
        if partition.error:
            yield batch_of([{**named, "error": partition.error}])
            return
        layout, n = partition.layout, len(partition.layout.channels)
        store, path = opened(self.path)[0], partition.path
        try:
            with store.open_input_file(path) as f:
                for first in range(partition.first, max(partition.last, partition.first + 1), ROW_SAMPLES):
                    count = min(ROW_SAMPLES, partition.last - first)
                    if layout.multiplexed:
                        f.seek(first * n * layout.width)
                        table = np.frombuffer(f.read(count * n * layout.width), layout.kind).reshape(-1, n)
                    for k in partition.channels:
                        name, scale = layout.channels[k]
                        if layout.multiplexed:
                            values = table[:, k]
                        else:
                            f.seek((k * partition.total + first) * layout.width)
                            values = np.frombuffer(f.read(count * layout.width), layout.kind)
                        if len(values) != count:
                            raise EOFError("the data file is shorter than when it was listed")
                        yield batch_of([{**named, "channel": name, "ch_idx": k, "fs": layout.fs, "start": first, "samples": values.astype(float) * scale}])
        except Exception as e:  # noqa: BLE001
            yield batch_of([{**named, "error": f"{type(e).__name__}: {e}"}])


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in ARROW], schema=ARROW)


class BrainVision(DataSource):
    """spark.read.format("brainvision").load(folder): a row for each channel and stretch of samples of each recording below the folder.

    Option `partBytes` sets how much of a data file one task reads. `start` is the number of a
    row's first sample. A recording that can't be read is a row with an error.
    """

    @classmethod
    def name(cls) -> str:
        return "brainvision"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:  # noqa: ANN001
        return Reader(unquote(self.options["path"]), int(self.options.get("partBytes", PART_BYTES)))


def pieces(spark: SparkSession, root: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of the source; filters on recordings and channels reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BrainVision)
    return spark.read.format("brainvision").option("partBytes", part_bytes).load(root)
