"""Windows by count of streamed samples: full ones only, whatever the order in which their samples arrive."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sigweave.operators import segment

#: Groups that windows are dealt to by a hash: the state of a group is its windows' samples and marks, as bytes of arrays.
BUCKETS, STATE = 1024, "kept binary"
#: What names a window (`empty`: its key is null), what is known of it, and its samples that are there.
NAME, MARK, SAMPLE = ["key", "empty", "window_idx"], ["until", "done"], ["at", "v"]


def full_windows(stream: DataFrame, key: str, at: str, value: str, time: str, length: int, step: int, late: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """key, window_idx, start, samples of each window of `length` samples, once all of them are there; rows are (key, at, value, time), `at` the sample's number.

    A sample goes to the few windows that its number says, and windows, also those of one
    series, are dealt over `buckets` groups, each of which takes its windows' samples of a
    batch together. Of samples that repeat a number the first counts. Samples later than
    `late` are dropped. A window whose samples lie behind the watermark is given up, and its
    samples with it, and so is the mark of one that was given out, which keeps repeated
    samples from giving it out again.
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.withWatermark(time, late).select(F.col(key).alias("key"), F.col(key).isNull().alias("empty"), F.col(at).cast("long").alias("at"), F.col(value).cast("double").alias("v"), F.col(time).alias("time"), F.explode(segment.windows_of(F.col(at), length, step)).alias("window_idx"))
    if kind in ("tinyint", "smallint", "int", "bigint"):
        rows = rows.withColumn("key", F.coalesce("key", F.lit(0).cast(kind)))  # pandas would make numbers beside nulls floats
    rows = rows.withColumns({"ms": F.unix_millis("time"), "bucket": F.pmod(F.xxhash64("key", "empty", "window_idx"), F.lit(buckets))})

    def gathered(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        marks, opened = pickle.loads(state.get[0]) if state.exists else (pd.DataFrame(columns=NAME + MARK), pd.DataFrame(columns=NAME + SAMPLE))
        arrived = [] if state.hasTimedOut else [b for b in batches if len(b)]
        new = pd.concat(arrived) if arrived else pd.DataFrame(columns=[*NAME, *SAMPLE, "ms"])
        names = pd.concat([x[NAME] for x in (marks, opened, new) if len(x)], ignore_index=True)
        code = names.groupby(NAME, sort=False, dropna=False).ngroup().to_numpy()
        there = names.iloc[np.unique(code, return_index=True)[1]].reset_index(drop=True)  # the windows by code
        own, rest = code[: len(marks)], code[len(marks) :]
        until, done = np.full(len(there), now, dtype="int64"), np.zeros(len(there), dtype=bool)
        until[own], done[own] = marks["until"].to_numpy("int64"), marks["done"].to_numpy(bool)
        np.maximum.at(until, rest[len(opened) :], np.maximum(new["ms"].to_numpy("int64"), now) + 1)
        alive = until >= now
        place = np.concatenate([x["at"].to_numpy("int64") - x["window_idx"].to_numpy("int64") * step for x in (opened, new)])
        wanted = alive[rest] & ~done[rest]
        slots, first = np.unique((rest * length + place)[wanted], return_index=True)  # the first of equal ones
        values = np.concatenate([x["v"].to_numpy("float64") for x in (opened, new)])[wanted][first]
        of = slots // length
        full = np.bincount(of, minlength=len(there)) == length
        if full.any():
            given = there[full]
            keys = given["key"].astype(object).mask(given["empty"].astype(bool), None) if given["empty"].any() else given["key"]
            index = given["window_idx"].to_numpy("int64")
            yield pd.DataFrame({key: keys.to_numpy(), "window_idx": index.astype("int32"), "start": index * step, "samples": list(values[full[of]].reshape(-1, length))})
        if not alive.any():
            state.remove()
            return
        kept = there[alive].assign(until=until[alive], done=(done | full)[alive])
        still = ~full[of]
        samples = there.iloc[of[still]].assign(v=values[still])
        samples["at"] = samples["window_idx"].to_numpy("int64") * step + slots[still] % length
        state.update((pickle.dumps((kept, samples)),))
        state.setTimeoutTimestamp(max(int(until[alive].min()), now + 1))

    out = f"`{key}` {kind}, window_idx int, start long, samples array<double>"
    return rows.groupBy("bucket").applyInPandasWithState(gathered, out, STATE, "append", GroupStateTimeout.EventTimeTimeout)
