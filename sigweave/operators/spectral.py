"""Spectral features of clips: Welch periodograms in an Arrow kernel, everything after as expressions.

Clips come one to a row as (any key columns, samples array<double>).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigweave import dims


def welch_segments(x: np.ndarray, nperseg: int, noverlap: int) -> np.ndarray:
    """Windowed spectra of the overlapping parts of a clip, each less its mean."""
    nperseg = min(nperseg, len(x))
    if noverlap >= nperseg:
        raise ValueError("the overlap must be less than the segment")
    step = nperseg - noverlap
    parts = np.lib.stride_tricks.sliding_window_view(x, nperseg)[::step]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    return np.fft.rfft((parts - parts.mean(1, keepdims=True)) * window, axis=1) / np.sqrt((window**2).sum())


def one_sided(power: np.ndarray, n: int, fs: float) -> np.ndarray:
    out = power / fs
    out[1 : len(out) - (n % 2 == 0)] *= 2
    return out


def psd(clips: DataFrame, fs: float, nperseg: int | None = None, noverlap: int | None = None) -> DataFrame:
    """Adds psd, the power at k * fs / nperseg for k = 0, 1, ...; segments default to two seconds that overlap by half. Null or empty clips get null."""
    size = nperseg or int(2 * fs)
    lap = size // 2 if noverlap is None else noverlap
    if lap >= size:
        raise ValueError("the overlap must be less than the segment")

    @F.pandas_udf("array<double>")
    def kernel(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for clips in batches:
            yield pd.Series([None if x is None or not len(x) else one_sided((np.abs(welch_segments(np.asarray(x, float), size, lap)) ** 2).mean(0), min(size, len(x)), fs) for x in clips])

    return clips.withColumn("psd", kernel("samples"))


def frequencies(psd_col: Column, fs: float, nperseg: int) -> Column:
    """(f, p) pairs of a psd array."""
    return F.transform(psd_col, lambda p, k: F.struct((k * F.lit(fs / nperseg)).alias("f"), p.alias("p")))


def band_power(spectra: DataFrame, fs: float, nperseg: int, keep: list[str], bands: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """keep..., band, band_idx, power: the trapezoid under the bins of each band, both ends included; 0 with fewer than two bins.

    The spectrum is computed once and the bands are made from it.
    """
    pairs = frequencies(F.col("psd"), fs, nperseg)

    def area(low: float, high: float) -> Column:
        inside = F.filter(F.col("__pairs"), lambda x: (x["f"] >= low) & (x["f"] <= high))
        parts = F.zip_with(F.slice(inside, F.lit(1), F.greatest(F.size(inside) - 1, F.lit(0))), F.slice(inside, F.lit(2), F.greatest(F.size(inside) - 1, F.lit(0))), lambda a, b: (a["p"] + b["p"]) / 2 * (b["f"] - a["f"]))
        return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)

    made = F.array(*(F.struct(F.lit(b).alias("band"), F.lit(i).alias("band_idx"), area(*edge).alias("power")) for i, (b, edge) in enumerate((bands or dims.BANDS).items())))
    return spectra.withColumn("__pairs", pairs).select(*keep, F.inline(made))


def spectral_features(spectra: DataFrame, fs: float, nperseg: int, keep: list[str]) -> DataFrame:
    """keep..., entropy, peak_frequency, centroid of the spectrum without its mean bin; the first bin wins ties, 0 ln 0 is 0."""
    pairs = F.filter(frequencies(F.col("psd"), fs, nperseg), lambda x: x["f"] > 0)
    total = F.aggregate("__pairs", F.lit(0.0), lambda s, x: s + x["p"])
    share = lambda x: x["p"] / F.col("__total")
    entropy = F.aggregate("__pairs", F.lit(0.0), lambda s, x: s - F.when(x["p"] > 0, share(x) * F.ln(share(x))).otherwise(0.0))
    peak = F.array_min(F.transform("__pairs", lambda x: F.struct((-x["p"]).alias("p"), x["f"].alias("f"))))["f"]
    centroid = F.aggregate("__pairs", F.lit(0.0), lambda s, x: s + x["f"] * share(x))
    made = spectra.withColumn("__pairs", pairs).withColumn("__total", total)
    return made.select(*keep, entropy.alias("entropy"), peak.alias("peak_frequency"), centroid.alias("centroid"))


def zscore(long: DataFrame, by: list[str], value: str = "value", log: bool = True, scale: float = 1.0) -> DataFrame:
    """Adds z: log1p of the scaled value, less the mean of its group, by the population deviation (1 where it is 0)."""
    x = F.log1p(F.col(value) * scale) if log else F.col(value)
    stats = long.groupBy(*by).agg(F.avg(x).alias("__mean"), F.stddev_pop(x).alias("__dev"))
    return long.join(stats, by).withColumn("z", (x - F.col("__mean")) / F.when(F.col("__dev") == 0, 1.0).otherwise(F.col("__dev"))).drop("__mean", "__dev")


def channel_pairs(clips: DataFrame, key: str) -> DataFrame:
    """Pairs of channels of an epoch, the first before the second: a hash join on the epoch with an inequality."""
    a = clips.select(key, F.col("ch_idx").alias("a_idx"), F.col("channel").alias("a"), F.col("samples").alias("x"))
    b = clips.select(key, F.col("ch_idx").alias("b_idx"), F.col("channel").alias("b"), F.col("samples").alias("y"))
    return a.join(b, key).filter("a_idx < b_idx")


def connectivity(pairs: DataFrame, fs: float, method: str = "coh", nperseg: int | None = None, noverlap: int | None = None) -> DataFrame:
    """Adds value: mean coherence over alpha and beta bins (`coh`), or the phase-locking value (`plv`)."""
    if method not in ("coh", "plv"):
        raise ValueError(f"unknown method {method!r}")
    size = nperseg or int(2 * fs)
    lap = size // 2 if noverlap is None else noverlap

    def coherence(x: np.ndarray, y: np.ndarray) -> float:
        n = min(size, len(x))
        a, b = welch_segments(x, size, lap), welch_segments(y, size, lap)
        with np.errstate(invalid="ignore", divide="ignore"):
            c = np.abs((a.conj() * b).mean(0)) ** 2 / ((np.abs(a) ** 2).mean(0) * (np.abs(b) ** 2).mean(0))
        f = np.arange(len(c)) * fs / n
        inside = np.zeros(len(c), bool)
        for band in ("alpha", "beta"):
            inside |= (f >= dims.BANDS[band][0]) & (f <= dims.BANDS[band][1])
        return float(c[inside].mean()) if inside.any() else float("nan")

    def locking(x: np.ndarray, y: np.ndarray) -> float:
        return float(np.abs(np.exp(1j * (phase(x) - phase(y))).mean()))

    of = coherence if method == "coh" else locking

    @F.pandas_udf("double")
    def kernel(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in batches:
            yield pd.Series([of(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(xs, ys, strict=True)])

    return pairs.withColumn("value", kernel("x", "y"))


def phase(x: np.ndarray) -> np.ndarray:
    """Phase of the analytic signal."""
    n = len(x)
    keep = np.zeros(n)
    keep[0] = 1
    keep[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        keep[n // 2] = 1
    return np.angle(np.fft.ifft(np.fft.fft(x) * keep))


@lru_cache(maxsize=64)
def filter_taps(fs: float, low: float, high: float, notch: float | None, n: int) -> tuple[np.ndarray, ...]:
    """The filters to apply one after the other, of `n` taps each: a band-pass, and a band-stop about the notch if it lies in the band that samples can show."""

    def below(edge: float) -> np.ndarray:
        t = np.arange(n) - n // 2
        h = 2 * edge / fs * np.sinc(2 * edge / fs * t) * np.hamming(n)
        return h / h.sum()

    unit = np.zeros(n)
    unit[n // 2] = 1
    passed = (below(high) if high < fs / 2 else unit) - below(low)
    return (passed, unit - (below(notch + 1) - below(notch - 1))) if notch and notch + 1 < fs / 2 else (passed,)


def taps_wanted(fs: float, low: float) -> int:
    """Taps of a filter, an odd number; shorter recordings have as many as they have samples, or one less."""
    return int(3.3 * fs / max(low, 0.5)) | 1


def convolved(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where h lies on x whole, the sums of products: by FFTs of overlapping blocks if h is long."""
    n, out = len(h), len(x) - len(h) + 1
    if n < 64:
        return np.convolve(x, h, "valid")
    size = 1 << (min(4 * n, len(x) + n) - 1).bit_length()
    step, spectrum = size - n + 1, np.fft.rfft(h, size)
    blocks = [np.fft.irfft(np.fft.rfft(x[at : at + size], size) * spectrum, size)[n - 1 : n - 1 + step] for at in range(0, out, step)]
    return np.concatenate(blocks)[:out]


def filtered(clips: DataFrame, fs: float, low: float = 0.5, high: float = 100.0, notch: float | None = 50.0) -> DataFrame:
    """samples, band-passed and notched by a zero-phase windowed sinc of odd length; edges are reflected. For arrays that fit in a row; see `filtered_parts`."""

    @F.pandas_udf("array<double>")
    def kernel(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in batches:
            out = []
            for x in xs:
                x = np.asarray(x, float)
                n = min(taps_wanted(fs, low), 2 * ((len(x) - 1) // 2) + 1)
                for h in filter_taps(fs, low, high, notch, n) if n >= 3 else ():
                    x = convolved(np.pad(x, n // 2, mode="reflect"), h)
                out.append(x)
            yield pd.Series(out)

    return clips.withColumn("samples", kernel("samples"))


def filtered_parts(parts: DataFrame, keep: list[str], fs: float, low: float = 0.5, high: float = 100.0, notch: float | None = 50.0) -> DataFrame:
    """What `filtered` gives, for recordings in parts (keep..., part, v): parts of one width, the last of a recording may be shorter.

    A part sends its neighbours the samples that lie within half a filter of them, so a task
    holds a part and its surroundings, whatever the recording's length. Reflection is made
    where a recording begins and ends. The second filter is another such step.
    """
    full = taps_wanted(fs, low)
    sizes = parts.groupBy(*keep).agg(F.sum(F.size("v").cast("long")).alias("__total"), F.max(F.size("v")).alias("__width"))
    sizes = sizes.withColumn("__taps", F.least(F.lit(full), 2 * F.floor((F.col("__total") - 1) / 2) + 1).cast("int")).withColumn("__half", F.floor(F.col("__taps") / 2))
    renamed = sizes.withColumnsRenamed({k: f"__{k}" for k in keep})
    same = reduce(lambda a, b: a & b, (parts[k].eqNullSafe(renamed[f"__{k}"]) for k in keep))
    rows = parts.join(renamed, same).select(*keep, "part", "v", "__total", "__width", "__taps", "__half")
    for number in range(len(filter_taps(fs, low, high, notch, 3))):
        rows = _filter_step(rows, keep, fs, low, high, notch, number)
    return rows.select(*keep, "part", "v")


def _filter_step(rows: DataFrame, keep: list[str], fs: float, low: float, high: float, notch: float | None, number: int) -> DataFrame:
    width, half, total = F.col("__width").cast("long"), F.col("__half"), F.col("__total")
    reach = F.ceil(half / width)
    sent = rows.withColumn("__to", F.explode(F.sequence(F.greatest(F.col("part") - reach, F.lit(0)), F.least(F.col("part") + reach, F.floor((total - 1) / width)))))
    begin, to = F.col("part") * width, F.col("__to") * width
    first = F.greatest(begin, to - half)
    count = F.least(begin + F.size("v"), to + width + half) - first
    cut = F.slice("v", (first - begin + 1).cast("int"), F.greatest(count, F.lit(0)).cast("int"))
    sent = sent.filter((count > 0) & (first >= begin)).select(*keep, F.col("__to").alias("part"), F.struct(first.alias("at"), cut.alias("v")).alias("__x"), "__total", "__width", "__taps", "__half")
    met = sent.groupBy(*keep, "part").agg(F.flatten(F.transform(F.array_sort(F.collect_list("__x")), lambda x: x["v"])).alias("v"), *(F.first(c).alias(c) for c in ("__total", "__width", "__taps", "__half")))
    begin = F.col("part") * width
    own = F.least(width, total - begin)
    left, right = F.greatest(half - begin, F.lit(0)), F.greatest(begin + own + half - total, F.lit(0))

    @F.pandas_udf("array<double>")
    def kernel(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, lefts, rights, taps in batches:
            out = []
            for x, a, b, n in zip(xs, lefts, rights, taps, strict=True):
                x = np.asarray(x, float)
                out.append(convolved(np.concatenate([x[1 : a + 1][::-1], x, x[len(x) - 1 - b : len(x) - 1][::-1]]), filter_taps(fs, low, high, notch, int(n))[number]) if n >= 3 else x)
            yield pd.Series(out)

    return met.withColumn("v", kernel("v", left.cast("int"), right.cast("int"), "__taps"))


#: Samples of a channel that meet those of other channels at a time.
PART = 4096


def sample_parts(clips: DataFrame, keep: list[str], column: str = "samples", width: int = PART) -> DataFrame:
    """keep..., part, v: the samples in parts of `width`."""
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(column) - 1) / width), F.lit(0)).cast("int")), lambda k: F.slice(F.col(column), k * width + 1, F.lit(width)))
    return clips.select(*keep, F.posexplode(parts).alias("part", "v"))


def joined_parts(parts: DataFrame, keep: list[str], name: str) -> DataFrame:
    """keep..., name: the parts one after the other again."""
    return parts.groupBy(*keep).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "v"))), lambda x: x["v"])).alias(name))


def average_reference(clips: DataFrame, key: str) -> DataFrame:
    """samples less the mean over the channels of the recording, sample by sample; of channels of unequal length those that have the sample count."""
    met = sample_parts(clips, [key, "ch_idx"]).groupBy(key, "part").agg(F.collect_list("v").alias("all"))
    longest = F.array_max(F.transform("all", F.size))
    mean = F.when(longest > 0, F.transform(F.sequence(F.lit(0), longest - 1), lambda i: F.aggregate("all", F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, v: F.struct((a["s"] + F.coalesce(F.get(v, i), F.lit(0.0))).alias("s"), (a["n"] + F.get(v, i).isNotNull().cast("int")).alias("n")), lambda a: a["s"] / a["n"]))).otherwise(F.array().cast("array<double>"))
    whole = joined_parts(met.select(key, "part", mean.alias("v")), [key], "__mean")
    return clips.join(whole, key).withColumn("samples", F.zip_with("samples", F.slice("__mean", F.lit(1), F.size("samples")), lambda v, m: v - m)).drop("__mean")


def channel_stats(clips: DataFrame) -> DataFrame:
    """Adds variance (population) and mean_abs of each channel's samples."""
    n = F.size("samples")
    mean = F.aggregate("samples", F.lit(0.0), lambda s, v: s + v) / n
    out = clips.withColumn("__m", mean)
    out = out.withColumn("variance", F.aggregate("samples", F.lit(0.0), lambda s, v: s + (v - F.col("__m")) * (v - F.col("__m"))) / n)
    return out.withColumn("mean_abs", F.aggregate("samples", F.lit(0.0), lambda s, v: s + F.abs(v)) / n).drop("__m")


def bad_channels(clips: DataFrame, key: str, limit: float = 3.0) -> DataFrame:
    """Adds variance_z, abs_z and bad: a statistic more than `limit` deviations from the channels' mean; constant statistics flag nothing."""
    w = W.partitionBy(key)
    z = lambda c: F.abs(F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_pop(c).over(w), F.lit(0.0))
    out = channel_stats(clips).withColumns({"variance_z": z("variance"), "abs_z": z("mean_abs")})
    return out.withColumn("bad", F.coalesce(F.col("variance_z") > limit, F.lit(False)) | F.coalesce(F.col("abs_z") > limit, F.lit(False)))


def positions(channels: list[str]) -> dict[str, tuple[float, float, float]]:
    """Places of named electrodes of the 10-20 system on a unit sphere: rows lie 18 degrees apart from ear to ear, numbers 18 degrees from the middle. Unknown names are left out."""
    rows = {"Fp": 72, "AF": 54, "F": 36, "FT": 18, "FC": 18, "T": 0, "C": 0, "TP": -18, "CP": -18, "P": -36, "PO": -54, "O": -72}
    out = {}
    for name in channels:
        row = name.rstrip("0123456789z")
        number = name[len(row) :]
        if row in rows and (number == "z" or number.isdigit()):
            n = 0 if number == "z" else int(number)
            side = -1 if n % 2 else 1
            front, out_by = np.radians(rows[row]), side * np.radians(18 * ((n + 1) // 2))
            out[name] = (float(np.cos(front) * np.sin(out_by)), float(np.sin(front)), float(np.cos(front) * np.cos(out_by)))
    return out


def positions_frame(spark, channels: list[str]) -> DataFrame:  # noqa: ANN001
    """channel, px, py, pz."""
    return spark.createDataFrame([(c, *xyz) for c, xyz in positions(channels).items()], "channel string, px double, py double, pz double")


def spline_weights(good: np.ndarray, bad: np.ndarray, stiffness: int = 4, terms: int = 50, smooth: float = 1e-5) -> np.ndarray:
    """Weights (bad by good) of a spherical spline through the good places, from unit vectors; each row sums to one."""

    def bend(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = np.arange(1, terms + 1)
        series = np.concatenate([[0], (2 * n + 1) / (n * (n + 1.0)) ** stiffness / (4 * np.pi)])
        return np.polynomial.legendre.legval(np.clip(a @ b.T, -1, 1), series)

    n = len(good)
    system = np.ones((n + 1, n + 1))
    system[:n, :n] = bend(good, good) + smooth * np.eye(n)
    system[n, n] = 0
    return np.hstack([bend(bad, good), np.ones((len(bad), 1))]) @ np.linalg.pinv(system)[:, :n]


def interpolated(clips: DataFrame, key: str, places: DataFrame) -> DataFrame:
    """samples of bad channels replaced by a spherical spline through the others of the recording (`places`: channel, px, py, pz; column bad).

    A recording's weights come from its channels' places alone; samples meet in parts.
    Channels without a place, and recordings without a good one, stay as they are.
    """
    at = clips.select(key, "channel", "bad").join(F.broadcast(places), "channel")
    lists = at.groupBy(key).agg(*(F.array_sort(F.collect_list(F.when(F.col("bad") == flag, F.struct("channel", "px", "py", "pz")))).alias(n) for n, flag in (("bads", True), ("goods", False))))
    kind = "array<struct<bad:string,good:string,w:double>>"

    @F.pandas_udf(kind)
    def weights(bads: pd.Series, goods: pd.Series) -> pd.Series:
        out = []
        for one, two in zip(bads, goods, strict=True):
            xyz = [np.array([[c["px"], c["py"], c["pz"]] for c in part], float).reshape(-1, 3) for part in (two, one)]
            xyz = [v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in xyz]
            w = spline_weights(*xyz) if len(xyz[0]) and len(xyz[1]) else np.zeros((0, 0))
            out.append([{"bad": one[i]["channel"], "good": two[j]["channel"], "w": float(w[i, j])} for i in range(w.shape[0]) for j in range(w.shape[1])])
        return pd.Series(out)

    pairs = lists.filter("size(bads) > 0").select(key, F.inline(weights("bads", "goods")))
    parts = sample_parts(clips.withColumnRenamed("channel", "good"), [key, "good"])
    met = pairs.join(parts, [key, "good"]).groupBy(key, "bad", "part").agg(F.collect_list(F.struct("w", "v")).alias("all"))
    shortest = F.array_min(F.transform("all", lambda x: F.size(x["v"])))
    total = F.transform(F.sequence(F.lit(0), shortest - 1), lambda i: F.aggregate("all", F.lit(0.0), lambda s, x: s + x["w"] * F.get(x["v"], i)))
    made = joined_parts(met.filter(shortest > 0).select(key, F.col("bad").alias("channel"), "part", total.alias("v")), [key, "channel"], "__new")
    return clips.join(made, [key, "channel"], "left").withColumn("samples", F.coalesce("__new", "samples")).drop("__new")


def apart(w: np.ndarray) -> np.ndarray:
    """The orthogonal matrix that is nearest to w."""
    u, _, v = np.linalg.svd(w, full_matrices=False)
    return u @ v


def components_of(x: np.ndarray, n: int, seed: int = 42, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(unmixing, mixing) of `n` independent components of channels (rows), by fixed-point steps with a symmetric decorrelation."""
    x = x - x.mean(1, keepdims=True)
    values, vectors = np.linalg.eigh(x @ x.T / max(x.shape[1], 1))
    order = np.argsort(-values)[: min(n, int((values > 1e-12 * max(values.max(), 1e-300)).sum()))]
    white = (vectors[:, order] / np.sqrt(values[order])).T
    z = white @ x
    w = apart(np.random.default_rng(seed).standard_normal((len(z), len(z))))
    for _ in range(rounds):
        g = np.tanh(w @ z)
        new = apart(g @ z.T / z.shape[1] - (1 - g**2).mean(1)[:, None] * w)
        moved = np.abs(np.abs((new * w).sum(1)) - 1).max() if len(w) else 0.0
        w = new
        if moved < 1e-6:
            break
    return w @ white, np.linalg.pinv(w @ white)


def without_artifacts(clips: DataFrame, key: str, fs: float, eye: list[str], n_components: int = 20, seed: int = 42, limit: float = 3.0) -> DataFrame:
    """samples without the independent components that follow an eye channel.

    A component goes if its correlation with a channel of `eye`, over 1 to 40 Hz, lies
    `limit` deviations or more from that of the others. The eye channels themselves stay as they
    are, and so does a recording without one. A recording's channels must meet, so one
    task holds one recording at a time.
    """
    names = clips.columns
    work = filtered(clips, fs, 1.0, 40.0, None).select(key, "channel", F.col("samples").alias("__low"))

    def clean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ch_idx", "channel"]).reset_index(drop=True)
        own = ~rows["channel"].isin(eye)
        n = min(map(len, rows["samples"]), default=0)
        if own.any() and not own.all() and n > 1:
            raw = np.stack([np.asarray(v[:n], float) for v in rows.loc[own, "samples"]])
            low = np.stack([np.asarray(v[:n], float) for v in rows["__low"]])
            unmix, mix = components_of(low[own.to_numpy()], n_components, seed)
            sources = unmix @ (low[own.to_numpy()] - low[own.to_numpy()].mean(1, keepdims=True))
            bad = np.zeros(len(sources), bool)
            for line in low[~own.to_numpy()]:
                with np.errstate(invalid="ignore", divide="ignore"):
                    r = np.nan_to_num([np.corrcoef(s, line)[0, 1] for s in sources])
                bad |= np.abs(r - r.mean()) >= limit * max(r.std(), 1e-12) if len(r) > 2 else np.abs(r) > 0.9
            mean = raw.mean(1, keepdims=True)
            left = raw - mix[:, bad] @ (unmix[bad] @ (raw - mean))
            rows.loc[own, "samples"] = pd.Series(list(left), index=rows.index[own])
        return rows[names]

    return clips.join(work, [key, "channel"]).groupBy(key).applyInPandas(clean, clips.schema)


def preprocessed(clips: DataFrame, key: str, fs: float, low: float = 0.5, high: float = 100.0, notch: float | None = 50.0, places: DataFrame | None = None, eye: list[str] | None = None, bad_limit: float = 3.0, in_parts: bool = False) -> dict[str, DataFrame]:
    """Every stage of the usual preparation, independent components of long recordings `in_parts`: raw, filtered, interpolated (with `places`), ica_cleaned (with `eye` channels), final (average reference). Nothing runs until a stage is used."""
    stages = {"raw": clips, "filtered": filtered(clips, fs, low, high, notch)}
    now = stages["filtered"]
    if places is not None:
        now = stages["interpolated"] = interpolated(bad_channels(now, key, bad_limit), key, places).select(clips.columns)
    if eye:
        from sigweave.operators import components

        now = stages["ica_cleaned"] = (components.without_artifacts if in_parts else without_artifacts)(now, key, fs, eye)
    stages["final"] = average_reference(now, key).select(clips.columns)
    return stages


def picked(clips: DataFrame, channels: list[str]) -> DataFrame:
    """The rows of those of the channels that are there; ch_idx keeps their order."""
    return clips.filter(F.col("channel").isin(channels))


def all_features(clips: DataFrame, fs: float, key: str, channels: list[str] | None = None, include_spectral: bool = True, include_connectivity: bool = False, method: str = "coh", normalize: bool = True, nperseg: int | None = None) -> DataFrame:
    """key, kind, feature, f_idx, value: band powers always (log and z-scored by feature if `normalize`), spectral features and connectivity of channel pairs if asked for.

    `clips` has key, channel, ch_idx, samples. The spectrum is made once for both kinds
    that need it. `method` is coh or plv; others are an error.
    """
    if method not in ("coh", "plv"):
        raise ValueError(f"unknown method {method!r}")
    clips = picked(clips, channels) if channels is not None else clips
    size = nperseg or int(2 * fs)
    spectra = psd(clips, fs, size, size // 2)
    power = band_power(spectra, fs, size, [key, "channel", "ch_idx"])
    power = power.select(key, F.concat_ws("_", "band", "channel").alias("feature"), (F.col("ch_idx") * 100 + F.col("band_idx")).alias("f_idx"), F.col("power").alias("value"))
    if normalize:
        power = zscore(power, ["feature"]).select(key, "feature", "f_idx", F.col("z").alias("value"))
    parts = [power.select(key, F.lit("band_power").alias("kind"), "feature", F.col("f_idx").cast("long").alias("f_idx"), "value")]
    if include_spectral:
        found = spectral_features(spectra, fs, size, [key, "channel", "ch_idx"])
        each = F.array(*(F.struct(F.concat_ws("_", F.lit(n), F.col("channel")).alias("feature"), (F.lit(1_000_000) + F.col("ch_idx") * 100 + i).cast("long").alias("f_idx"), F.col(c).alias("value")) for i, (n, c) in enumerate((("entropy", "entropy"), ("peak_freq", "peak_frequency"), ("centroid", "centroid")))))
        parts.append(found.select(key, F.lit("spectral").alias("kind"), F.inline(each)))
    if include_connectivity:
        met = connectivity(channel_pairs(clips, key), fs, method, size, size // 2)
        parts.append(met.select(key, F.lit("connectivity").alias("kind"), F.concat_ws("_", F.lit("conn"), "a", "b").alias("feature"), (F.lit(2_000_000) + F.col("a_idx") * 1000 + F.col("b_idx")).cast("long").alias("f_idx"), "value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def quality(clips: DataFrame, markers: DataFrame, key: str, channels: int = 64, rate: float = 1000.0, classes: int = 4, events: int = 100) -> DataFrame:
    """key and five flags: channel count, sampling rate (column fs), class count, number of events, no flat channel."""
    a = channel_stats(clips).groupBy(key).agg((F.count("*") == channels).alias("has_channels"), (F.max("fs") == rate).alias("has_rate"), (F.min("variance") >= 1e-12).alias("no_flat_channel"))
    b = markers.groupBy(key).agg((F.count_distinct("event_id") == classes).alias("has_classes"), (F.count("*") >= events).alias("has_events"))
    return a.join(b, key, "left").fillna(False, ["has_classes", "has_events"])
