"""Language identification by piece unigrams, summed over all segmentations.

Each language has probabilities of the pieces of a fixed public vocabulary, all of
which are used; a character that no piece holds is spelled by its bytes, which are
pieces of that vocabulary too. The probability of a word is the sum over all ways to
cut it into pieces, by a forward pass over its characters, for all distinct words of
a batch and all languages at once; a text's is the product of all its words'.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.llm.shared import bounded_batches, hashed_share, stored

#: Labelled documents that training uses in expectation (all, if there are no more), those of the least hashes of their ids.
LABELLED = 4000
#: Rounds of expectation maximisation, what is added to each expected count, and the least probability of a piece.
STEPS, ADDED, FLOOR = 4, 0.01, 1e-8
#: Symbols after which sums are scaled, for each word and language; longer words are cut into such parts in training alone.
PART = 16
#: Parts of words of a language that are counted at a time.
COUNTED = 20_000
#: Words whose scores a worker keeps; beyond, it starts anew.
KEPT_WORDS = 300_000
UNDECIDED = "und"
START = "▁"


def vocabulary(path: str) -> list[str]:
    """The pieces of a SentencePiece file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


@dataclass
class Lattice:
    """The pieces as a trie over symbols: numbers of characters from 1 on, then 256 bytes. Edges are sorted by node and symbol; node 1 is the root."""

    chars: dict[str, int]
    edges: np.ndarray
    child: np.ndarray
    piece: np.ndarray
    n_pieces: int

    @property
    def width(self) -> int:
        return len(self.chars) + 257

    @classmethod
    def of(cls, pieces: list[str]) -> Lattice:
        """Of all pieces, and each of their characters and each byte as a piece of its own; piece 0 is none."""
        chars = {c: k + 1 for k, c in enumerate(dict.fromkeys([START, *(c for p in pieces for c in p)]))}
        first = len(chars) + 1
        edges: dict[tuple[int, int], int] = {}
        piece, n = [0, 0], 0
        for symbols in [*([chars[c] for c in p] for p in pieces), *([k] for k in range(1, first + 256))]:
            node = 1
            for k in symbols:
                if (node, k) not in edges:
                    edges[node, k] = len(piece)
                    piece.append(0)
                node = edges[node, k]
            if not piece[node]:
                n += 1
                piece[node] = n
        keys = np.array([node * (first + 256) + k for node, k in edges], np.int64)
        order = np.argsort(keys)
        return cls(chars, keys[order], np.array(list(edges.values()), np.int32)[order], np.array(piece, np.int32), n + 1)

    def codes(self, word: str, begin: bool = True) -> list[int]:
        """Symbols of a word, after the mark of a word's begin."""
        out, first = [self.chars[START]] if begin else [], len(self.chars) + 1
        for c in word:
            k = self.chars.get(c)
            if k:
                out.append(k)
            else:
                out += [first + b for b in c.encode("utf-8", "surrogatepass")]
        return out

    def groups(self, words: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yields (places in `words`, symbols) of the words of each length."""
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w), []).append(k)
        for n, places in by.items():
            block = max(1, 200_000 // max(n, 1))
            for at in range(0, len(places), block):
                yield np.array(places[at : at + block]), np.array([words[k] for k in places[at : at + block]], np.int64).reshape(-1, n)

    def pieces_from(self, code: np.ndarray, start: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Yields (size, rows, pieces): the rows of `code` that have a piece of this size from `start` on."""
        row, node = np.arange(len(code)), np.ones(len(code), np.int64)
        for size in range(1, code.shape[1] - start + 1):
            key = node * self.width + code[row, start + size - 1]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            met = self.edges[at] == key
            row, node = row[met], self.child[at[met]].astype(np.int64)
            if not len(row):
                return
            piece = self.piece[node]
            some = piece > 0
            if some.any():
                yield size, row[some], piece[some]

    def log_probabilities(self, words: list[list[int]], p: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's probability (rows) in each language (columns); p: pieces by languages, 0 for no piece."""
        out = np.zeros((len(words), p.shape[1]))
        for places, code in self.groups(words):
            m, n = code.shape
            alpha = {0: np.ones((m, p.shape[1]))}
            scale = np.zeros((m, p.shape[1]))
            for start in range(n):
                here = alpha.pop(start)
                for size, row, piece in self.pieces_from(code, start):
                    if start + size not in alpha:
                        alpha[start + size] = np.zeros((m, p.shape[1]))
                    alpha[start + size][row] += here[row] * p[piece]
                if start % PART == PART - 1:  # what is under way for each word and language keeps within a double's range
                    top = np.maximum.reduce(list(alpha.values()))
                    alpha = {k: v / top for k, v in alpha.items()}
                    scale += np.log(top)
            out[places] = np.log(alpha[n]) + scale
        return out

    def expected(self, words: list[list[int]], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected number of each piece in the words (of PART symbols at most) under one language's probabilities."""
        pieces, weights = [np.empty(0, np.int32)], [np.empty(0)]
        for places, code in self.groups(words):
            m, n = code.shape
            alpha, beta = np.zeros((n + 1, m)), np.zeros((n + 1, m))
            alpha[0], beta[n] = 1, 1
            found = [list(self.pieces_from(code, start)) for start in range(n)]
            for start in range(n):
                for size, row, piece in found[start]:
                    alpha[start + size, row] += alpha[start, row] * p[piece]
            share = counts[places] / np.maximum(alpha[n], 1e-300)
            for start in range(n - 1, -1, -1):
                for size, row, piece in found[start]:
                    beta[start, row] += beta[start + size, row] * p[piece]
                    pieces.append(piece)
                    weights.append(alpha[start, row] * p[piece] * beta[start + size, row] * share[row])
        return np.bincount(np.concatenate(pieces), np.concatenate(weights), self.n_pieces)


@dataclass
class Languages:
    names: list[str]
    lattice: Lattice
    p: np.ndarray


def words_of(text: str) -> list[str]:
    return text.lower().split()


def train(docs: DataFrame, path: str) -> Languages | None:
    """Fits piece probabilities to labelled documents (doc_id, text, lang) by expectation maximisation; None without any.

    All words of the sampled documents count, long ones in parts. Each round is one job over the distinct words.
    """
    bounded_batches(docs.sparkSession)
    known = docs.filter("doc_id is not null and text is not null and lang is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    sample = known.filter(hashed_share("doc_id", LABELLED, known.count()))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["lang", "word", "n"])

    counts = stored(sample.select("lang", "text").mapInArrow(made, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    names = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not names:
        return None
    lattice = Lattice.of(vocabulary(path))
    p = np.full((lattice.n_pieces, len(names)), 1.0 / lattice.n_pieces)
    p[0] = 0
    index = {name: k for k, name in enumerate(names)}
    for _ in range(STEPS):
        begun = docs.sparkSession.sparkContext.broadcast((lattice, p))

        def of(batches: Iterator[pa.RecordBatch], begun=begun) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            lattice, p = begun.value
            total = np.zeros_like(p)
            parts: list[tuple[list, list]] = [([], []) for _ in names]

            def count(k: int) -> None:
                codes, n = parts[k]
                total[:, k] += lattice.expected(codes, np.array(n, float), p[:, k])
                codes.clear()
                n.clear()

            for batch in batches:
                for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    k, code = index[lang], lattice.codes(word)
                    for at in range(0, len(code), PART):
                        parts[k][0].append(code[at : at + PART])
                        parts[k][1].append(n)
                    if len(parts[k][0]) >= COUNTED:
                        count(k)
            for k in range(len(names)):
                count(k)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total.ravel()[some])], ["cell", "n"])

        table = counts.mapInArrow(of, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # pieces times languages at most
        total = np.zeros(p.size)
        total[table["cell"].to_numpy()] = table["n"].to_numpy()
        p = total.reshape(p.shape) + ADDED
        p[0] = 0
        p = np.maximum(p / p.sum(0), FLOOR)
        p[0] = 0
        begun.unpersist()
    return Languages(names, lattice, p)


def identified(docs: DataFrame, model: Languages | None) -> DataFrame:
    """Columns doc_id, lang_pred, score: one row for each row of `docs` (doc_id, text); other columns are ignored.

    `score` is the language's share of the summed probabilities (all languages alike
    beforehand) of all words of the text. A text that is null or has no letter is
    `und`, with score 0; so is every text if no language was learned. The first
    language by name wins a tie. Ids may be null or repeated.
    """
    bounded_batches(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[str, int] = {}
        table = np.zeros((0, 0 if model is None else len(model.names)))
        for batch in batches:
            names, scores = [], []
            texts = [words_of(t) if t and any(map(str.isalpha, t)) else [] for t in batch.column(1).to_pylist()]
            if model is not None:
                if len(index) > KEPT_WORDS:
                    index, table = {}, table[:0]
                new = [w for w in dict.fromkeys(w for t in texts for w in t) if w not in index]
                index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
                table = np.concatenate([table, model.lattice.log_probabilities([model.lattice.codes(w) for w in new], model.p)])
            for words in texts:
                if model is None or not words:
                    names.append(UNDECIDED)
                    scores.append(0.0)
                    continue
                total = table[list(map(index.__getitem__, words))].sum(0)
                share = np.exp(total - total.max())
                best = int(np.argmax(share))
                names.append(model.names[best])
                scores.append(float(share[best] / share.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, "doc_id long, lang_pred string, score double")
