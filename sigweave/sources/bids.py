"""Readers of a BIDS folder: participants, sidecars, BrainVision recordings and markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.sources import brainvision

PARTICIPANTS = "participant_id string, age string, sex string, Height string, Weight string"
SIDECAR = "EEGChannelCount int, SamplingFrequency double, RecordingDuration double"
SESSIONS = ["session1", "session2", "session3"]


def participants(spark: SparkSession, root: str, subjects: list[str] | None = None) -> DataFrame:
    """file_order, subject_id, age, sex, height, weight; `n/a` is null. An empty or missing list of subjects keeps all."""
    raw = spark.read.option("header", True).option("sep", "\t").option("nullValue", "n/a").option("enforceSchema", False).csv(f"{root}/participants.tsv")
    have = {c: F.col(c) if c in raw.columns else F.lit(None) for c in ("participant_id", "age", "sex", "Height", "Weight")}
    raw = raw.withColumn("__at", F.monotonically_increasing_id())  # grows along the file, which one task reads
    rows = raw.select(F.col("__at").alias("file_order"), have["participant_id"].alias("subject_id"), have["age"].try_cast("double").cast("int").alias("age"), F.lower(have["sex"].cast("string")).alias("sex"), have["Height"].try_cast("double").alias("height"), have["Weight"].try_cast("double").alias("weight"))
    return rows.filter(F.col("subject_id").isin(subjects)) if subjects else rows


def of_subjects(rows: DataFrame, subjects: DataFrame, key: str = "subject_id") -> DataFrame:
    """The rows of the subjects in a table, however many it has; a subject that stands twice counts once, a null one never."""
    return rows.join(subjects.select(key), key, "left_semi").select(rows.columns)


def first_subjects(rows: DataFrame, n: int) -> DataFrame:
    """The first n subjects in the order of the file, or of their ids if that isn't known."""
    return rows.orderBy("file_order" if "file_order" in rows.columns else "subject_id").limit(n)


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """subject, session, task and the declared channel count, rate and duration of each recording."""
    rows = spark.read.schema(SIDECAR).option("multiLine", True).json(f"{root}/sub-*/ses-*/eeg/*_eeg.json").withColumn("path", F.input_file_name())
    part = lambda p: F.regexp_extract("path", p, 1)
    return rows.select(part(r"sub-([^/_]+)_").alias("subject"), part(r"_ses-([^/_]+)_").alias("session"), part(r"_task-([^/_]+)_").alias("task"), F.col("EEGChannelCount").alias("n_channels"), F.col("SamplingFrequency").alias("sampling_rate"), F.col("RecordingDuration").alias("recording_duration"))


def dataset_info(spark: SparkSession, root: str, name: str = "dataset") -> DataFrame:
    """One row: number of subjects, and channels, rate, duration and tasks of the recordings."""
    people = participants(spark, root).agg(F.count("*").alias("n_subjects"))
    side = sidecars(spark, root).agg(F.max("n_channels").alias("n_channels"), F.max("sampling_rate").alias("sampling_rate"), F.max("recording_duration").alias("recording_duration"), F.array_sort(F.collect_set("task")).alias("tasks"))
    return people.crossJoin(side).withColumn("name", F.lit(name))


def grid(subjects: DataFrame, sessions: list[str], tasks: list[str]) -> DataFrame:
    """Every recording to look for: subject_id, session, task, trial_id."""
    rows = subjects.select("subject_id", F.explode(F.array(*map(F.lit, sessions))).alias("session")).select("*", F.explode(F.array(*map(F.lit, tasks))).alias("task"))
    return rows.withColumn("trial_id", F.concat(F.col("subject_id"), F.lit("_ses-"), F.col("session"), F.lit("_task-"), F.col("task")))


def recordings(spark: SparkSession, root: str, part_bytes: int = brainvision.PART_BYTES) -> DataFrame:
    """One row for each channel of each recording: trial_id, channel, ch_idx, fs, samples in the header's unit; what can't be read has an error and no samples.

    For recordings that fit in a row; longer ones are read as `brainvision.pieces`, whose
    tasks and rows are bounded. A recording of which a part can't be read has no samples.
    """
    rows = brainvision.pieces(spark, root, part_bytes)
    bad = rows.filter("error is not null").groupBy("trial_id").agg(F.min("error").alias("error"))
    parts = F.array_sort(F.collect_list(F.struct("start", "samples")))
    good = rows.filter("error is null").groupBy("trial_id", "channel", "ch_idx", "fs").agg(F.flatten(F.transform(parts, lambda x: x["samples"])).alias("samples"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("channel", "string"), ("ch_idx", "int"), ("fs", "double"), ("samples", "array<double>"))]
    whole = good.join(bad.select("trial_id"), "trial_id", "left_anti").withColumn("error", F.lit(None).cast("string"))
    return whole.unionByName(bad.select("trial_id", *none, "error"))


def markers(spark: SparkSession, root: str) -> DataFrame:
    """trial_id, sample_idx, event_id of the marker files; event_id is the number in the marker's description."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.vmrk").option("recursiveFileLookup", True).text(root).withColumn("path", F.input_file_name())
    line = rows.select(F.regexp_extract("path", r"([^/]+?)(_eeg)?\.vmrk$", 1).alias("trial_id"), F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^Mk[0-9]+=([^\r\n]*)"), F.lit(1))).alias("mk"))
    part = F.split("mk", ",")
    return line.select("trial_id", F.get(part, F.lit(2)).try_cast("long").alias("sample_idx"), F.regexp_extract(F.get(part, F.lit(1)), r"(\d+)", 1).try_cast("int").alias("event_id"))
