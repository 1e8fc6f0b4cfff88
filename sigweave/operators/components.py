"""Independent components of recordings in parts, by sums of small matrices.

Means, covariances and each fixed-point step are sums over samples, so a task sees one
part of a recording and hands on a matrix as wide as its channels. All recordings go
through their steps together; those that have settled leave. Memory doesn't grow with a
recording's length: its matrices are merged in two levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.operators import spectral
from sigweave.scratch import written

#: Parts whose sums are merged in one task first.
MERGED = 64
STATE = "white binary, mean binary, w binary, rows int, cols int, moved double"
NAMES = [c.split()[0] for c in STATE.split(", ")]


def blocks(clips: DataFrame, key: str, column: str = "samples", width: int = spectral.PART) -> DataFrame:
    """key, part, x: the samples of all channels (channel by channel, by ch_idx) of each stretch; a channel that ends early cuts the stretch."""
    parts = spectral.sample_parts(clips, [key, "ch_idx"], column, width)
    return parts.groupBy(key, "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("ch_idx", "v"))), lambda x: x["v"]).alias("x"), F.count("*").alias("n_ch"))


def _matrix(x: list) -> np.ndarray:
    n = min(map(len, x))
    return np.stack([np.asarray(v[:n], float) for v in x])


def _merged(a: tuple, b: tuple) -> tuple:
    """(n, mean, products about the mean) of two sets of samples together."""
    n = a[0] + b[0]
    step = b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def moments(found: DataFrame, key: str) -> DataFrame:
    """key, n, mean, products (about the mean) of the blocks of each recording; stretches with fewer channels than others don't count."""
    kind = found.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, g long, n long, n_ch int, mean binary, products binary"

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, part, x in zip(batch[key], batch["part"], batch["x"], strict=True):
                m = _matrix(x)
                if m.shape[1]:
                    mean = m.mean(1)
                    centred = m - mean[:, None]
                    out.append((k, part // MERGED, m.shape[1], len(m), mean.tobytes(), (centred @ centred.T).tobytes()))
            yield pd.DataFrame(out, columns=[key, "g", "n", "n_ch", "mean", "products"])

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        size = int(rows["n_ch"].max())
        total = None
        for n, n_ch, mean, products in rows[["n", "n_ch", "mean", "products"]].itertuples(index=False):
            if n_ch == size:
                one = (n, np.frombuffer(mean), np.frombuffer(products).reshape(size, size))
                total = one if total is None else _merged(total, one)
        return pd.DataFrame([(rows[key].iloc[0], 0, total[0], size, total[1].tobytes(), total[2].tobytes())], columns=[key, "g", "n", "n_ch", "mean", "products"])

    parts = found.select(key, "part", "x").mapInPandas(own, schema)
    return parts.groupBy(key, "g").applyInPandas(together, schema).groupBy(key).applyInPandas(together, schema)


def unmixed(found: DataFrame, key: str, sums: DataFrame, n: int, seed: int = 42, rounds: int = 200) -> DataFrame:
    """key, unmix (components by channels), mean: `n` independent components of each recording, by fixed-point steps with a symmetric decorrelation.

    `sums` are the blocks' moments. The steps are those of `spectral.components_of`, which
    holds a recording at once; a recording leaves when its directions have settled.
    """
    kind = found.schema[key].dataType.simpleString()

    def begun(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, count, n_ch, mean, products in zip(batch[key], batch["n"], batch["n_ch"], batch["mean"], batch["products"], strict=True):
                values, vectors = np.linalg.eigh(np.frombuffer(products).reshape(n_ch, n_ch) / max(count, 1))
                order = np.argsort(-values)[: min(n, int((values > 1e-12 * max(values.max(), 1e-300)).sum()))]
                white = (vectors[:, order] / np.sqrt(values[order])).T
                w = spectral.apart(np.random.default_rng(seed).standard_normal((len(white), len(white))))
                out.append((k, white.tobytes(), mean, w.tobytes(), len(white), int(n_ch), 1.0 if len(white) else 0.0))
            yield pd.DataFrame(out, columns=[key, *NAMES])

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, part, x, white, mean, w, rows, cols in zip(*(batch[c] for c in (key, "part", "x", "white", "mean", "w", "rows", "cols")), strict=True):
                m = _matrix(x)
                if len(m) != cols or not m.shape[1]:
                    continue
                z = np.frombuffer(white).reshape(rows, cols) @ (m - np.frombuffer(mean)[:, None])
                g = np.tanh(np.frombuffer(w).reshape(rows, rows) @ z)
                out.append((k, part // MERGED, m.shape[1], (g @ z.T).tobytes(), (1 - g**2).sum(1).tobytes()))
            yield pd.DataFrame(out, columns=[key, "g", "n", "gz", "slope"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        total = [sum(np.frombuffer(b) for b in rows[c]) for c in ("gz", "slope")]
        return pd.DataFrame([(rows[key].iloc[0], 0, rows["n"].sum(), total[0].tobytes(), total[1].tobytes())], columns=[key, "g", "n", "gz", "slope"])

    def moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, count, gz, slope, white, mean, w, rows, cols in zip(*(batch[c] for c in (key, "n", "gz", "slope", "white", "mean", "w", "rows", "cols")), strict=True):
                old = np.frombuffer(w).reshape(rows, rows)
                new = spectral.apart(np.frombuffer(gz).reshape(rows, rows) / count - (np.frombuffer(slope) / count)[:, None] * old)
                out.append((k, white, mean, new.tobytes(), rows, cols, float(np.abs(np.abs((new * old).sum(1)) - 1).max())))
            yield pd.DataFrame(out, columns=[key, *NAMES])

    schema = f"{key} {kind}, {STATE}"
    partial = f"{key} {kind}, g long, n long, gz binary, slope binary"
    state = written(sums.mapInPandas(begun, schema), "components")
    settled = state.filter("moved < 1e-6")
    active = state.filter("moved >= 1e-6")
    for _ in range(rounds):
        if active.isEmpty():
            break
        met = found.select(key, "part", "x").join(active.drop("moved"), key)
        totals = met.mapInPandas(step, partial).groupBy(key, "g").applyInPandas(added, partial).groupBy(key).applyInPandas(added, partial)
        state = written(totals.join(active.drop("moved"), key).mapInPandas(moved, schema), "components")
        settled, active = settled.union(state.filter("moved < 1e-6")), state.filter("moved >= 1e-6")

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(batch[key], batch["w"], batch["white"], batch["rows"], batch["cols"], batch["mean"], strict=True)
            yield pd.DataFrame([(k, (np.frombuffer(w).reshape(r, r) @ np.frombuffer(white).reshape(r, c)).tobytes(), r, c, mean) for k, w, white, r, c, mean in rows], columns=[key, "unmix", "rows", "cols", "mean"])

    return settled.union(active).mapInPandas(finished, f"{key} {kind}, unmix binary, rows int, cols int, mean binary")


def without_artifacts(clips: DataFrame, key: str, fs: float, eye: list[str], n_components: int = 20, seed: int = 42, limit: float = 3.0, width: int = spectral.PART) -> DataFrame:
    """What `spectral.without_artifacts` gives, with no recording in a task.

    Components come from the channels that aren't in `eye`, over 1 to 40 Hz. How they go with
    eye channels is a product of the components' weights and the channels' covariances. A
    recording without an eye channel or without others stays as it is, as do channels' samples
    beyond the shortest channel of a stretch.
    """
    names = clips.columns
    low = spectral.filtered(clips, fs, 1.0, 40.0, None).withColumn("__eye", F.col("channel").isin(eye))
    sides = low.groupBy(key).agg(F.count_if("__eye").alias("__n_eye"), F.count("*").alias("__n_all"))
    # the channels themselves first, eye channels after them
    low = low.join(sides.filter("__n_eye > 0 and __n_eye < __n_all"), key).withColumn("ch_idx", F.col("ch_idx") + F.when(F.col("__eye"), 1 << 20).otherwise(0))
    every = written(blocks(low, key, width=width), "low")
    own = written(blocks(low.filter("not __eye"), key, width=width), "own")
    sums = written(moments(every, key), "moments")
    own_sums = moments(own, key)
    made = unmixed(own, key, own_sums, n_components, seed)
    kind = clips.schema[key].dataType.simpleString()

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, unmix, rows, cols, n_ch, products in zip(*(batch[c] for c in (key, "unmix", "rows", "cols", "n_ch", "products")), strict=True):
                u, c = np.frombuffer(unmix).reshape(rows, cols), np.frombuffer(products).reshape(n_ch, n_ch)
                spread = np.sqrt(np.einsum("ij,jk,ik->i", u, c[:cols, :cols], u))
                bad = np.zeros(rows, bool)
                for line in range(cols, n_ch):
                    with np.errstate(invalid="ignore", divide="ignore"):
                        r = np.nan_to_num(u @ c[:cols, line] / (spread * np.sqrt(c[line, line])))
                    bad |= np.abs(r - r.mean()) >= limit * max(r.std(), 1e-12) if len(r) > 2 else np.abs(r) > 0.9
                # samples less what the bad components make of them
                out.append((k, (np.linalg.pinv(u)[:, bad] @ u[bad]).tobytes(), cols))
            yield pd.DataFrame(out, columns=[key, "gone", "cols"])

    gone = made.join(sums.select(key, "n_ch", "products"), key).mapInPandas(chosen, f"{key} {kind}, gone binary, cols int")
    raw = clips.filter(~F.col("channel").isin(eye)).join(gone.select(key), key, "left_semi")
    raw_blocks = blocks(raw, key, width=width)
    means = moments(raw_blocks, key).select(key, "mean")
    order = raw.groupBy(key).agg(F.array_sort(F.collect_list(F.col("ch_idx").cast("int"))).alias("idx"))

    def cleaned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, part, x, matrix, cols, mean, idx in zip(*(batch[c] for c in (key, "part", "x", "gone", "cols", "mean", "idx")), strict=True):
                m = _matrix(x)
                if len(m) == cols:
                    m = m - np.frombuffer(matrix).reshape(cols, cols) @ (m - np.frombuffer(mean)[:, None])
                    out += [(k, int(i), part, row) for i, row in zip(idx, m, strict=True)]
            yield pd.DataFrame(out, columns=[key, "ch_idx", "part", "v"])

    met = raw_blocks.select(key, "part", "x").join(gone, key).join(means, key).join(order, key)
    parts = met.mapInPandas(cleaned, f"{key} {kind}, ch_idx int, part int, v array<double>")
    new = spectral.joined_parts(parts, [key, "ch_idx"], "__new")
    kept = clips.withColumn("__own", ~F.col("channel").isin(eye)).join(new, [key, "ch_idx"], "left")
    return kept.withColumn("samples", F.when(F.col("__own"), F.coalesce("__new", "samples")).otherwise(F.col("samples"))).select(names)
