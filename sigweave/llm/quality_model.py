"""A quality classifier by co-training of two views.

One view sees the content of a text (significant words and counted statistics),
the other the metadata of the page (source, language, stated length). Each view is
calibrated on labels that it isn't fitted to. Over some rounds each gives the other
the unlabelled documents it is surest of, with its calibrated probabilities as
labels, so a view that knows little also claims little. In the end the calibrated
log odds of both are added, as of views that are independent given the label, and
the sum is calibrated on labels that neither view has met.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.llm.shared import bounded_batches, hashed_share, stored
from sigweave.llm.words import hashed_words, shingles

#: Labelled and unlabelled rows that training uses in expectation (all, if there are no more), those of the least hashes of their ids.
LABELLED, UNLABELLED = 8000, 4000
#: Rounds, documents of either label that a view gives the other in each, and what one of them weighs beside a labelled one.
ROUNDS, EXCHANGED, TRUST = 3, 200, 0.3
#: Documents from which a source or language has a feature of its own; the rarer ones of a kind share one.
LEAST_KIND = 5
#: Words that the text view keeps at most, and what makes one significant.
WORDS, LEAST_DOCS, LEAST_Z = 2000, 8, 5.0
STATS = ("words", "word_bytes", "symbols", "capitals", "digits", "other_bytes", "repeats", "repeated_windows")
BINS = 10
_SYMBOL, _CAPITAL, _DIGIT = np.zeros(256), np.zeros(256), np.zeros(256)
_SYMBOL[[ord(c) for c in "#*$%&|<>!{}=_~^\\"]] = 1
_CAPITAL[65:91] = 1
_DIGIT[48:58] = 1


def text_features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields (distinct word hashes, statistics) of each text."""
    raw = texts.cast(pa.large_binary()).fill_null(b"")
    sizes = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    for row, h, at in hashed_words(texts):
        for i in range(len(at) - 1):
            own = h[at[i] : at[i + 1]]
            counts = np.bincount(data[sizes[row + i] : sizes[row + i + 1]], minlength=256)
            n, chars = max(len(own), 1), max(int(counts.sum() - counts[9:14].sum() - counts[32]), 1)
            windows = shingles(own, 3)
            words = np.unique(own)
            yield words, np.array([np.log1p(len(own)), chars / n, counts @ _SYMBOL / n, counts @ _CAPITAL / chars, counts @ _DIGIT / n, counts[128:].sum() / chars, 1 - len(words) / n, 1 - len(np.unique(windows)) / max(len(windows), 1)])


#: What the metadata view sees of a page.
KINDS = ("source", "lang", "length")


def meta_values(sources: list, langs: list, lengths: list) -> list[tuple]:
    """Of each page its source, its language, and its stated length in powers of 1.5; nulls are values too."""
    return [(s, x, None if n is None else int(np.log1p(max(n, 0)) / np.log(1.5))) for s, x, n in zip(sources, langs, lengths, strict=True)]


class Sparse:
    """A matrix of zeros and ones by the places of the ones in each row, of which each has some."""

    def __init__(self, rows: list[np.ndarray], width: int) -> None:
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.at = np.concatenate(rows).astype(np.int32)
        self.width = width

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v[self.at], self.starts)

    def gathered(self, g: np.ndarray) -> np.ndarray:
        """The product of the transposed matrix with a number for each row."""
        return np.bincount(self.at, np.repeat(g, self.sizes), self.width)


def fitted(x: np.ndarray | Sparse, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, steps: int = 120) -> np.ndarray:
    """Weights of a logistic regression by accelerated gradient steps; the last column of x is the constant's, rows of weight 0 count nothing."""
    gathered, squares, width = (x.gathered, x.sizes, x.width) if isinstance(x, Sparse) else (x.T.__matmul__, np.einsum("ij,ij->i", x, x), x.shape[1])
    w = np.zeros(width)
    v, weight = w.copy(), weight / weight.sum()
    rate = 4.0 / max(float(weight @ squares), 1e-9)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        new = v - rate * 4 * (gathered(weight * (p - y)) + penalty * np.append(v[:-1], 0))
        v, w = new + k / (k + 3) * (new - w), new
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def calibration(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and offset that turn scores into log odds (a logistic regression on them); the slope isn't below 0, a constant's is 0."""
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    spread = z.std() if len(z) else 0.0
    if spread < 1e-9 or len({*y}) < 2:
        return np.array([0.0, prior])
    scaled = (z - z.mean()) / spread
    w = fitted(np.stack([scaled, np.ones(len(z))], 1), y, np.ones(len(z)), 1e-3, 300)
    return np.array([w[0] / spread, w[1] - w[0] * z.mean() / spread]) if w[0] > 0 else np.array([0.0, prior])


@dataclass
class Model:
    """Both views' weights, how each is calibrated (slope, offset), and how their sum is.

    `prior` are the log odds of all labels, which both views' log odds hold;
    `exchanged` counts what each view has taught the other.
    """

    words: np.ndarray
    edges: np.ndarray
    cells: list[dict]
    text: np.ndarray = field(default_factory=lambda: np.zeros(0))
    meta: np.ndarray = field(default_factory=lambda: np.zeros(0))
    views: list[np.ndarray] = field(default_factory=list)
    both: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))
    prior: float = 0.0
    exchanged: list[int] = field(default_factory=lambda: [0, 0])

    def text_row(self, words: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """Places of the features of a text that are 1."""
        at = np.searchsorted(self.words, words)
        at = at[(at < len(self.words)) & (self.words[np.minimum(at, len(self.words) - 1)] == words)] if len(self.words) else np.empty(0, np.int64)
        return np.concatenate([at, len(self.words) + np.arange(len(STATS)) * (BINS + 1) + (stats[:, None] > self.edges).sum(1), [len(self.words) + len(STATS) * (BINS + 1)]])

    def meta_row(self, values: tuple) -> np.ndarray:
        """The same for a page's metadata: a place for each kind, the kind's first one if the value is rare, and the constant's."""
        starts = np.cumsum([0, *(len(c) + 1 for c in self.cells)])
        return np.array([*(start + of.get(v, 0) for start, of, v in zip(starts, self.cells, values, strict=False)), starts[-1]])

    def log_odds(self, scores: list[np.ndarray]) -> np.ndarray:
        """Of both views together, from the views' raw scores."""
        one, two = (slope * z + offset for (slope, offset), z in zip(self.views, scores, strict=True))
        return self.both[0] * (one + two - self.prior) + self.both[1]

    def scores(self, texts: pa.Array, values: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds of each view, and of both."""
        raw = [np.array([self.text[self.text_row(*f)].sum() for f in text_features(texts)]), np.array([self.meta[self.meta_row(v)].sum() for v in values])]
        one, two = (slope * z + offset for (slope, offset), z in zip(self.views, raw, strict=True))
        return one, two, self.log_odds(raw)


def significant(words: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Sorted hashes of the WORDS words whose share of documents differs most between the labels."""
    bad_n, good_n = (good == 0).sum(), (good == 1).sum()
    seen, where = np.unique(np.concatenate(words), return_inverse=True)
    label = np.repeat(good, [len(w) for w in words])
    n_bad, n_good = np.bincount(where, label == 0, len(seen)), np.bincount(where, label == 1, len(seen))
    p = (n_bad + n_good) / len(good)
    z = np.abs(n_bad / bad_n - n_good / good_n) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / bad_n + 1 / good_n))
    z[(n_bad + n_good < LEAST_DOCS) | (z < LEAST_Z)] = 0
    chosen = np.argsort(-z, kind="stable")[:WORDS]
    return np.sort(seen[chosen[z[chosen] > 0]])


def co_trained(good: np.ndarray, words: list[np.ndarray], stats: np.ndarray, values: list[tuple]) -> Model | None:
    """The model of a sample; `good` is NaN where there is no label. None if the labels to fit to are of one class."""
    known, free = np.flatnonzero(~np.isnan(good)), np.flatnonzero(np.isnan(good))
    part = np.arange(len(known)) % 6
    fit, held, last = known[part > 1], known[part == 0], known[part == 1]
    if len({*good[fit]}) < 2:
        return None
    cells = []
    for k in range(len(KINDS)):
        often = sorted((v for v, n in Counter(values[i][k] for i in known).items() if n >= LEAST_KIND), key=str)
        cells.append({v: i + 1 for i, v in enumerate(often)})
    model = Model(significant([words[i] for i in fit], good[fit]), np.quantile(stats[fit], np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T, cells)
    model.prior = float(np.log((good[known] == 1).sum() + 1) - np.log((good[known] == 0).sum() + 1))
    views = [Sparse([model.text_row(*f) for f in zip(words, stats, strict=True)], len(model.words) + len(STATS) * (BINS + 1) + 1), Sparse([model.meta_row(v) for v in values], sum(len(c) + 1 for c in cells) + 1)]

    told = [np.where(np.isin(np.arange(len(good)), fit), good, 0.0) for _ in views]  # what each view learns from
    trust = [np.isin(np.arange(len(good)), fit).astype(float) for _ in views]
    for turn in range(ROUNDS):
        weights = [fitted(x, y, w) for x, y, w in zip(views, told, trust, strict=True)]
        raw = [x @ w for x, w in zip(views, weights, strict=True)]
        model.views = [calibration(z[held], good[held]) for z in raw]
        if turn < ROUNDS - 1 and len(free):
            for k, (slope, offset) in enumerate(model.views):
                z = slope * raw[k][free] + offset
                order = free[np.argsort(z, kind="stable")]
                sure = np.unique(np.concatenate([order[:EXCHANGED], order[-EXCHANGED:]])) if slope > 0 else order[:0]
                told[1 - k][sure] = _sigmoid(slope * raw[k][sure] + offset)
                trust[1 - k][sure] = TRUST
                model.exchanged[k] += len(sure)
    model.text, model.meta = weights
    model.both = np.array([1.0, 0.0])
    if len({*good[last]}) == 2:
        slope, offset = calibration(model.log_odds([z[last] for z in raw]), good[last])
        model.both = np.array([slope, offset]) if slope > 0 else model.both
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Trains in one task on a bounded, hashed sample. None if the labels hold fewer than two classes."""
    bounded_batches(docs.sparkSession)
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("doc_id is not null and (q is not null or t is not null)")
    known = stored(known.select("doc_id", F.expr("cast(coalesce(q, 1) = 1 and coalesce(t, 0) = 0 as double)").alias("good")), "labels")
    n_known = known.count()
    sample = known.filter(hashed_share("doc_id", LABELLED, n_known))
    unlabelled = hashed_share("doc_id", UNLABELLED, docs.count() - min(n_known, LABELLED))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(text_features(batch.column(1)))
            columns = [batch.column(0), batch.column(5), pa.array([w.view(np.int64) for w, _ in found], pa.list_(pa.int64())), pa.array([s for _, s in found], pa.list_(pa.float64())), *(batch.column(k) for k in (2, 3, 4))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "good", "words", "stats", "source", "lang", "n_chars"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, model = [b for b in batches if b.num_rows], None
        if parts:
            rows = pa.Table.from_batches(parts).sort_by([("doc_id", "ascending"), ("n_chars", "ascending")]).combine_chunks()
            words = [w.values.to_numpy().view(np.uint64) for w in rows["words"]]
            model = co_trained(rows["good"].to_numpy(), words, np.array(rows["stats"].to_pylist()), meta_values(*(rows[k].to_pylist() for k in ("source", "lang", "n_chars"))))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    rows = _pages(docs).join(F.broadcast(sample), "doc_id", "left").filter(F.col("doc_id").isNotNull() & (F.col("good").isNotNull() | unlabelled))
    rows = stored(rows.mapInArrow(made, "doc_id long, good double, words array<long>, stats array<double>, source string, lang string, n_chars long"), "features")
    found = rows.coalesce(1).mapInArrow(fit, "model binary").collect()
    return pickle.loads(bytes(found[0].model)) if found else None


def _pages(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, model: Model | None = None) -> DataFrame:
    """Columns doc_id, text_score, meta_score, score, kept: one row for each row of `docs` (doc_id, text, source, lang, n_chars).

    `score` is the calibrated probability that a document is good (quality 1, not
    toxic), `text_score` and `meta_score` are those of the two views; `kept` says
    whether `score` reaches the threshold. Labels of a document that differ count as
    the worst. Null texts count as empty, other nulls as values of their own; a row
    without doc_id is scored and never trained on, repeated rows are scored alike.
    Without labels of two classes all scores are 1. Other columns are ignored.
    """
    model = model or train(docs, labels)
    bounded_batches(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                one = two = p = np.ones(batch.num_rows)
            else:
                one, two, p = map(_sigmoid, model.scores(batch.column(1), meta_values(*(batch.column(k).to_pylist() for k in (2, 3, 4)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(one, pa.float64()), pa.array(two, pa.float64()), pa.array(p, pa.float64()), pa.array(p >= threshold)], ["doc_id", "text_score", "meta_score", "score", "kept"])

    return _pages(docs).mapInArrow(made, "doc_id long, text_score double, meta_score double, score double, kept boolean")


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier keeps, with all columns as they came, in one pass over the texts; nulls, repeats and labels as in `scored`."""
    model = train(docs, labels)
    if model is None:
        return docs
    bounded_batches(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
            p = _sigmoid(model.scores(column["text"], meta_values(*(column[k].to_pylist() for k in ("source", "lang", "n_chars"))))[2])
            yield batch.filter(pa.array(p >= threshold))

    return docs.mapInArrow(made, docs.schema)
