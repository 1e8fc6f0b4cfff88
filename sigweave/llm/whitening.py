"""Whitening of vectors by singular values of the centred rows, never by a matrix of products.

Each task reduces its centred rows to a triangle R by QR, block by block, and groups of
triangles are reduced likewise until one is left, whose singular values are those of all
rows. Householder reflections make R bidiagonal; the differential qd algorithm with
shifts (dqds) finds the singular values to high relative accuracy; for each of them a
factorization twisted at its most singular place gives the direction. Small matrices
only reach the driver: their size is that of a vector's, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.llm.shared import stored

#: An entry c becomes floor(SCALE * c) + OFFSET; entries of LARGEST and more in size count as not finite, since that must be exact.
SCALE, OFFSET, LARGEST = 64.0, 1_000_000, 1e12
#: Rows that one QR step takes in; bytes of triangles that one task reduces; components at most.
BLOCK, FAN_BYTES, COMPONENTS = 4096, 64 << 20, 32
#: Singular values below this share of the largest can't be told from rounding: their components are left out.
RANK = 1e-11
EPS = np.finfo(float).eps


# --- singular values and directions of one small matrix ---------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right vectors V of the upper bidiagonal B with r = U B V', by Householder reflections."""
    n = r.shape[1]
    a = np.vstack([r, np.zeros((max(0, n - len(r)), n))])
    v = np.eye(n)

    def reflected(x: np.ndarray) -> tuple[np.ndarray, float, float]:
        """u, beta, alpha with (I - beta u u') x = (alpha, 0 ..)."""
        u = x.copy()
        size = np.linalg.norm(x)
        if size == 0:
            return u, 0.0, 0.0
        alpha = -size if x[0] >= 0 else size
        u[0] -= alpha
        return u, 2.0 / (u @ u), alpha

    for k in range(n):
        u, beta, alpha = reflected(a[k:, k])
        a[k:, k:] -= beta * np.outer(u, u @ a[k:, k:])
        a[k, k] = alpha if beta else a[k, k]
        if k < n - 2:
            u, beta, alpha = reflected(a[k, k + 1 :])
            a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ u, u)
            v[:, k + 1 :] -= beta * np.outer(v[:, k + 1 :] @ u, u)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), v


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential qd step: q, e and the auxiliary d of the shifted array."""
    d, qs, es, ds = q[0] - shift, [], [], []
    for i in range(len(e)):
        ds.append(d)
        top = d + e[i] or 1e-300
        t = q[i + 1] / top
        qs.append(top)
        es.append(e[i] * t)
        d = d * t - shift
    ds.append(d)
    return [*qs, d], es, ds


def squared_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of a bidiagonal's singular values, largest first, each to high relative accuracy (zeros become tiny).

    A step without shift gives the diagonal of the inverse as 1 / d, so 1 / sum(1 / d) is a
    lower bound of the least value, and a shift that keeps all positive. Values leave the
    array from its end as their coupling vanishes.
    """
    n = len(diagonal)
    top = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0)) if n else 0.0
    if top == 0.0:
        return np.zeros(n)
    q = [max(float(x) ** 2, 1e-60) for x in diagonal / top]
    e = [max(float(x) ** 2, 1e-120) for x in above / top]
    found, total = [], 0.0
    while q:
        while len(q) > 1:
            if e[-1] <= (EPS * EPS) * (total + q[-1]) or e[-1] <= EPS * EPS * 1e-60:
                break
            q0, e0, ds = _dqds(q, e, 0.0)
            shift = 1.0 / sum(1.0 / max(d, 1e-290) for d in ds)
            if shift <= EPS * total:  # too little to change the sum: a step without it
                q, e = q0, e0
                continue
            q1, e1, ds = _dqds(q, e, shift)
            while min(ds) < 0:  # rounding put the bound over the least value
                shift *= 0.9
                q1, e1, ds = _dqds(q, e, shift)
            q, e, total = q1, e1, total + shift
        found.append(total + q.pop())
        if e:
            e.pop()
    return np.sort(np.array(found))[::-1] * top * top


def twisted_vector(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """Unit vector of B'B for one of its eigenvalues, from the factorization twisted where its pivot is least.

    The stationary qd step runs down, the progressive one up; where they meet with the
    least residual the vector is one, and it follows by multiplications alone.
    """
    q, n = diagonal**2, len(diagonal)
    along = diagonal[:-1] * above  # off the diagonal of B'B
    tiny = EPS * EPS * max(q.max(), (above**2).max(initial=0.0), 1e-300)
    # down: L+ D+ L+' = B'B - value, with s the stationary remainder
    down, s = np.empty(n), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        down[i] = s[i] + q[i]
        down[i] = down[i] if abs(down[i]) > tiny else tiny
        s[i + 1] = above[i] ** 2 * (s[i] / down[i]) - value
    down[n - 1] = s[n - 1] + q[n - 1]
    # up: U- R- U-' = B'B - value, with p the progressive remainder
    up, p = np.empty(n), np.empty(n)
    p[n - 1] = q[n - 1] - value
    for i in range(n - 2, -1, -1):
        up[i + 1] = above[i] ** 2 + p[i + 1]
        up[i + 1] = up[i + 1] if abs(up[i + 1]) > tiny else tiny
        p[i] = p[i + 1] * (q[i] / up[i + 1]) - value
    k = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -along[i] / down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -along[i] / up[i + 1] * z[i]
    return z / np.linalg.norm(z)


def _solved(diagonal: np.ndarray, above: np.ndarray, value: float, b: np.ndarray) -> np.ndarray:
    """x with (B'B - value) x = b, pivots kept off zero: a step of inverse iteration."""
    main, off = diagonal**2, diagonal[:-1] * above
    main = main.copy()
    main[1:] += above**2
    main -= value
    n, tiny = len(main), EPS * max(np.abs(main).max(), np.abs(off).max(initial=0.0), 1e-300)
    rows = [[main[i], off[i] if i < n - 1 else 0.0, 0.0] for i in range(n)]
    x = b.copy()
    for i in range(n - 1):  # with row exchanges
        low = [off[i], main[i + 1], off[i + 1] if i < n - 2 else 0.0]
        if abs(low[0]) > abs(rows[i][0]):
            rows[i], low = low, rows[i]
            x[i], x[i + 1] = x[i + 1], x[i]
        rows[i][0] = rows[i][0] or tiny
        f = low[0] / rows[i][0]
        rows[i + 1] = [low[1] - f * rows[i][1], low[2] - f * rows[i][2], 0.0]
        x[i + 1] -= f * x[i]
    for i in range(n - 1, -1, -1):
        if i < n - 1:
            x[i] -= rows[i][1] * x[i + 1]
        if i < n - 2:
            x[i] -= rows[i][2] * x[i + 2]
        x[i] /= rows[i][0] if abs(rows[i][0]) > tiny else tiny
    return x / np.linalg.norm(x)


def eigen(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of r, largest first, and unit right vectors as columns.

    Values that lie closer than a thousandth are one cluster: its vectors are made orthogonal,
    by further steps of inverse iteration where that leaves too little of one. Signs are set
    so that a vector's entry of largest size is positive.
    """
    diagonal, above, v = bidiagonal(r)
    n = len(diagonal)
    if not n:
        return np.empty(0), np.empty((0, 0))
    top = max(np.abs(diagonal).max(), np.abs(above).max(initial=0.0)) or 1.0
    diagonal, above = diagonal / top, above / top
    above = np.where(np.abs(above) > EPS, above, 0.0)
    # where B falls apart (what rounding left of a coupling is none), each part has values of its own
    cuts = [0, *(np.flatnonzero(above == 0.0) + 1), n]
    values, vectors = [], []
    random = np.random.Generator(np.random.PCG64(7))
    for a, b in zip(cuts, cuts[1:]):
        d, u = diagonal[a:b], above[a : b - 1]
        cluster, last = [], None
        for value in squared_values(d, u):
            if last is None or last - value > 1e-3 * last:
                cluster = []
            x = twisted_vector(d, u, value)
            for again in range(8 if cluster else 0):
                for y in 2 * cluster:
                    x = x - (y @ x) * y
                left = np.linalg.norm(x)
                x = x / left if left > 1e-8 else random.standard_normal(b - a)
                if left > 1e-3 or again == 7:
                    break
                x = _solved(d, u, value, x)
            cluster.append(x)
            last = value
            whole = np.zeros(n)
            whole[a:b] = x
            values.append(value)
            vectors.append(whole)
    order = np.argsort(-np.array(values), kind="stable")
    out = v @ np.array(vectors).T[:, order]
    out *= np.sign(out[np.abs(out).argmax(0), np.arange(n)])
    return np.array(values)[order] * top * top, out


# --- over a table ------------------------------------------------------------------------


def _vectors(column: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows count, and their entries as integers x (rows by dimensions); without `size` all counting rows must be as long as each other."""
    column = column.cast(pa.large_list(pa.float64()))
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), -1)
    flat = column.flatten()
    entries = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(column)), np.maximum(lengths, 0))
    bad = ~(np.abs(entries) < LARGEST)
    counts = (lengths > 0) & (np.bincount(owner[bad], minlength=len(column)) == 0)
    if size is not None:
        counts &= lengths == size
    kept = entries[counts[owner]]
    width = size or (int(lengths[counts][0]) if counts.any() else 0)
    return counts, (np.floor(SCALE * kept).astype(np.int64) + OFFSET).reshape(-1, width or 1)


def _sums(rows: DataFrame) -> tuple[int, int, list[int]]:
    """Rows that count, their length and the sum of each dimension; of several lengths the one of most rows (the longest of those) counts."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            column = batch.column(0)
            for size in np.unique(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)):
                if size:
                    counts, x = _vectors(column, int(size))
                    if len(x):
                        n, s = found.get(int(size), (0, 0))
                        found[int(size)] = (n + len(x), s + x.sum(0))
        for size, (n, s) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, v)) for v in (size, n)] + [pa.array(np.arange(size)), pa.array(s)], ["size", "n", "dim", "s"])

    parts = rows.mapInArrow(made, "size long, n long, dim long, s long")
    totals = parts.groupBy("size", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    best = totals.agg(F.max(F.struct("n", "size"))).first()[0]
    if best is None:
        return 0, 0, []
    found = totals.filter(F.col("size") == best["size"]).orderBy("dim").collect()
    return best["n"], best["size"], [r["s"] for r in found]


def _triangle(blocks: Iterator[np.ndarray], size: int) -> np.ndarray:
    r = np.zeros((0, size))
    for block in blocks:
        r = np.linalg.qr(np.vstack([r, block]), mode="r")
    return r


def _reduced(rows: DataFrame, size: int, n: int, sums: np.ndarray) -> np.ndarray:
    """The triangle of all centred rows: of each task's rows, then of groups of triangles that fit in a task."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[np.ndarray]:
            for batch in batches:
                x = _vectors(batch.column(0), size)[1]
                for at in range(0, len(x), BLOCK):
                    yield (n * x[at : at + BLOCK] - sums) / n

        r = _triangle(blocks(), size)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _triangle((np.frombuffer(b.as_py()).reshape(-1, size) for batch in batches for b in batch.column(0)), size)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    fan = max(2, FAN_BYTES // (8 * size * size))
    rs = stored(rows.mapInArrow(first, "r binary"), "triangles")
    left = rs.count()
    while left > 1:
        left = -(-left // fan)
        rs = stored(rs.repartition(left).mapInArrow(more, "r binary"), "triangles")
        left = rs.count()
    return np.frombuffer(rs.first()[0]).reshape(-1, size)


@dataclass(frozen=True)
class Whitener:
    """Rows n, sums of the dimensions, eigenvalues of the covariance (divisor n) and directions as columns, of the components that stand out from rounding; share of each in the trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    directions: np.ndarray
    explained: np.ndarray

    @property
    def size(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.directions / np.sqrt(self.values))


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitener | None:
    """The whitening of all vectors that count, or None if none does.

    A row whose vector is null or empty or holds a null, a not finite entry or one of LARGEST
    doesn't count; of several lengths that of most rows does. Equal vectors and a constant
    dimension only lower the rank: there are as many components as the rank allows.
    """
    rows = rows.select(F.col(vector))
    n, size, sums = _sums(rows)
    if not n:
        return None
    s = np.array(sums, np.int64)
    values, vectors = eigen(_reduced(rows, size, n, s))
    if len(values) < 1 or values[0] <= 0:
        return Whitener(n, s, np.empty(0), np.empty((size, 0)), np.empty(0))
    k = min(components, int((values > values[0] * RANK**2).sum()))
    return Whitener(n, s, values[:k] / n, vectors[:, :k], values[:k] / values.sum())


def identity_error(rows: DataFrame, w: Whitener, vector: str = "embedding") -> float:
    """The largest entry in size of the whitened vectors' covariance minus the identity.

    Each task centres its blocks by their own means and merges products and means pairwise;
    so do the tasks' rows, which are as many as tasks and as small as the components.
    """
    k = len(w.values)
    if not k:
        return 0.0

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (0, np.zeros(k), np.zeros((k, k)))
        for batch in batches:
            x = _vectors(batch.column(0), w.size)[1]
            for at in range(0, len(x), BLOCK):
                y = w.whitened(x[at : at + BLOCK])
                mean = y.mean(0)
                total = _merged(total, (len(y), mean, (y - mean).T @ (y - mean)))
        yield _moments(total)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (0, np.zeros(k), np.zeros((k, k)))
        for batch in batches:
            for n, mean, products in zip(*(c.to_pylist() for c in batch.columns)):
                total = _merged(total, (n, np.frombuffer(mean), np.frombuffer(products).reshape(k, k)))
        yield _moments(total)

    schema = "n long, mean binary, products binary"
    parts = stored(rows.select(vector).mapInArrow(made, schema), "moments")
    fan = max(2, FAN_BYTES // (8 * k * k))
    left = parts.count()
    while left > 1:
        left = -(-left // fan)
        parts = stored(parts.repartition(left).mapInArrow(merged, schema), "moments")
    found = parts.first()
    covariance = np.frombuffer(found["products"]).reshape(k, k) / found["n"]
    return float(np.abs(covariance - np.eye(k)).max())


def _merged(a: tuple, b: tuple) -> tuple:
    """Counts, means and centred products of two sets put together."""
    n = a[0] + b[0]
    if not n:
        return a
    step = b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def _moments(total: tuple) -> pa.RecordBatch:
    arrays = [pa.array([total[0]], pa.int64()), pa.array([total[1].tobytes()], pa.binary()), pa.array([total[2].tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["n", "mean", "products"])


def _deviations(n: int, x: np.ndarray, sums: np.ndarray) -> pa.Array:
    """Sums of squares of n * x - S, exact; null where a long can't hold one."""
    d = n * x - sums
    if (np.square(d.astype(float)).sum(1) < 2.0**62).all():
        return pa.array(np.square(d).sum(1), pa.int64())
    exact = [sum(int(v) ** 2 for v in row) for row in d]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def whitened(rows: DataFrame, w: Whitener | None, vec_id: str = "vec_id", vector: str = "embedding", error: float | None = None) -> DataFrame:
    """A row for each vector that counts and each component: vec_id, component (from 1), n, deviation, whitened, explained, and `error` as identity_error.

    Ids may repeat or be null. Vectors that don't count give no row, as does a table whose vectors are all equal.
    """
    kind = rows.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    if w is None or not len(w.values):
        return rows.sparkSession.createDataFrame([], schema)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        for batch in batches:
            counts, x = _vectors(batch.column(1), w.size)
            if not len(x):
                continue
            ids = batch.column(0).filter(pa.array(counts))
            deviation = _deviations(w.n, x, w.sums)
            each = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(k * len(x), w.n)), deviation.take(each)]
            columns += [pa.array(w.whitened(x).ravel()), pa.array(np.tile(w.explained, len(x))), pa.array(np.full(k * len(x), error), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(made, schema)
