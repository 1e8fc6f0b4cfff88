"""Benchmark decontamination by spaced-seed hashing.

Each mask names the words of a window that count; the others may differ. Windows
of benchmark items and documents meet by the hash of the words that count, and
each hit's diagonal is verified word by word around it, with substitutions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.llm.shared import bounded_batches, sized_join, stored
from sigweave.llm.words import PLACES, hashed_words, mixed

#: 1: the word counts. Each mask has six words of nine or ten.
MASKS = ("111011100", "110100111", "101110011", "1101001011")
SPAN = max(map(len, MASKS))
#: Items shorter than SPAN are looked up whole, and with each single word left out, so that one substitution doesn't hide them;
#: items of fewer words than LEAST_WORDS match only documents that say nothing else.
LEAST_WORDS = 5
#: A passage counts with so many equal words, or with so many hundredths of the item's words if that is fewer.
ENOUGH_WORDS, ENOUGH_PERCENT = 12, 80
#: A substitution costs so many equal words.
MISMATCH = 2
#: Benchmark hashes up to which the documents' own are sieved by a table in memory before they are joined.
SIEVED = 4_000_000
SIEVE_LOG2 = 24


def masks_of(lengths: list[int]) -> list[tuple[int, list[int], int]]:
    """(number, places that count, words) of each mask; from 100 on those of short items: 100 times the words, and 1 more than the word left out."""
    masks = [(i, [k for k, c in enumerate(m) if c == "1"], len(m)) for i, m in enumerate(MASKS)]
    for n in lengths:
        masks += [(100 * n + left, [k for k in range(n) if k != left - 1], n) for left in range(n + 1 if n >= LEAST_WORDS else 1)]
    return masks


def _seeds(h: np.ndarray, at: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (mask, places, hashes) over all texts of a chunk."""
    ends = np.repeat(at[1:], np.diff(at))
    for name, ones, span in masks_of(lengths):
        n = len(h) - span + 1
        if n <= 0:
            continue
        total = np.full(n, name + 1, np.uint64)
        for k, place in enumerate(ones):
            total += h[place : place + n] * PLACES[k]
        inside = np.flatnonzero(ends[:n] >= np.arange(span, n + span))
        yield name, inside, mixed(total[inside])


def _seed_rows(table: DataFrame, key: str, lengths: list[int], sieve: np.ndarray | None, item: bool) -> DataFrame:
    """Columns id, mask, place, seed of the windows of `text`; a sieve lets through only seeds that may be in it."""
    bounded_batches(table.sparkSession)
    packed = None if sieve is None else np.packbits(sieve)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = None if packed is None else np.unpackbits(packed).view(bool)
        for batch in batches:
            ids = batch.column(0)
            for row, h, at in hashed_words(batch.column(1)):
                sizes = np.diff(at)
                for mask, place, seed in _seeds(h, at, lengths):
                    if cells is not None:
                        hit = np.flatnonzero(cells[(seed >> np.uint64(64 - SIEVE_LOG2)).astype(np.int64)])
                        place, seed = place[hit], seed[hit]
                    text = np.searchsorted(at, place, "right") - 1
                    if (item and mask >= 100) or 100 <= mask < 100 * LEAST_WORDS:  # a short item counts whole, and a very short one for whole documents
                        whole = sizes[text] == mask // 100
                        place, seed, text = place[whole], seed[whole], text[whole]
                    if len(place):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(text + row)), pa.array(np.full(len(place), mask, np.int32)), pa.array((place - at[text]).astype(np.int64)), pa.array(seed.view(np.int64))], ["id", "mask", "place", "seed"])

    return table.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), "text").mapInArrow(made, "id long, mask int, place long, seed long")


def _hash_lists(table: DataFrame, key: str) -> DataFrame:
    """Columns id and words, the hashes of all words of the text."""
    bounded_batches(table.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(h, at) for _, h, at in hashed_words(batch.column(1))]
            lengths = np.concatenate([np.diff(at) for _, at in parts] or [np.empty(0, np.int64)])
            words = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]).astype(np.int32)), pa.array(np.concatenate([*(h for h, _ in parts), np.empty(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), words], ["id", "words"])

    return table.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), "text").mapInArrow(made, "id long, words array<long>")


def overlap(equal: np.ndarray) -> tuple[int, int, int]:
    """(equal words, first, end) of the stretch of a diagonal with the most equal words, less MISMATCH for each other word."""
    if not len(equal):
        return 0, 0, 0
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -MISMATCH))])
    least = np.minimum.accumulate(total)
    end = int(np.argmax(total - least))
    first = int(np.argmin(total[: end + 1]))
    return int(equal[first:end].sum()), first, end


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Columns doc_id, item_id, n_matched, n_words, start, span: each document with each item it holds a passage of.

    `start` and `span` count the document's words under the passage, of the diagonal
    with the most equal words (the first of several). Words are lower-cased (A-Z). A
    null or blank item and a null text match nothing; an item of under LEAST_WORDS words
    matches documents that are this item and nothing else, one of under SPAN words
    passages of the same length with at most one in five words replaced. Rows without
    doc_id or item_id have no result. Repeated rows give one result. Other columns are
    ignored.
    """
    items = stored(_hash_lists(benchmark, "item_id").dropDuplicates(["id", "words"]), "items")
    lengths = [r[0] for r in items.select(F.size("words").alias("n")).filter(f"n >= 1 and n < {SPAN}").distinct().collect()]
    tests = stored(_seed_rows(benchmark, "item_id", sorted(lengths), None, True).distinct(), "tests")
    sieve = None
    if tests.count() <= SIEVED:
        cells = tests.select(F.shiftrightunsigned("seed", 64 - SIEVE_LOG2).alias("cell")).distinct().toPandas()["cell"].to_numpy()
        sieve = np.zeros(1 << SIEVE_LOG2, bool)
        sieve[cells.astype(np.int64)] = True
    hits = _seed_rows(docs, "doc_id", sorted(lengths), sieve, False)
    tests = tests.select("mask", "seed", F.col("id").alias("item_id"), F.col("place").alias("item_place"))
    lines = sized_join(hits, tests, ["mask", "seed"], "inner").select(F.col("id").alias("doc_id"), "item_id", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    lines = stored(lines, "diagonals")
    wanted = stored(lines.select("doc_id").distinct(), "suspects")
    words = stored(_hash_lists(sized_join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted, ["doc_id"], "left_semi"), "doc_id").dropDuplicates(["id", "words"]), "words")
    met = sized_join(lines, items.select(F.col("id").alias("item_id"), F.col("words").alias("item")), ["item_id"], "inner")
    met = met.join(words.withColumnRenamed("id", "doc_id"), "doc_id")
    # only the words beside the item go on
    met = met.select("doc_id", "item_id", "item", F.greatest("shift", F.lit(0)).alias("start"), F.greatest(-F.col("shift"), F.lit(0)).cast("int").alias("skip"), F.expr("slice(words, cast(greatest(shift, 0) as int) + 1, cast(size(item) + least(shift, 0) as int))").alias("beside"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, item_id, item, start, skip, beside in zip(*(batch.column(k) for k in range(6)), strict=True):
                one, two = item.values.to_numpy(zero_copy_only=False)[skip.as_py() :], beside.values.to_numpy(zero_copy_only=False)
                n = min(len(one), len(two))
                equal = one[:n] == two[:n]
                # of a short item all words count, of others the best stretch
                matched, first, end = overlap(equal) if len(item.values) >= SPAN else (int(equal.sum()), 0, n) if n == len(item.values) else (0, 0, 0)
                if matched >= min(ENOUGH_WORDS, -(-ENOUGH_PERCENT * len(item.values) // 100)):
                    rows.append((doc.as_py(), item_id.as_py(), matched, len(item.values), start.as_py() + first, end - first))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "n_matched", "n_words", "start", "span"])

    good = met.mapInArrow(verified, "doc_id long, item_id long, n_matched long, n_words long, start long, span long")
    best = F.max(F.struct("n_matched", (-F.col("start")).alias("back"), "n_words", "span")).alias("best")
    return good.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_matched", "best.n_words", (-F.col("best.back")).alias("start"), "best.span")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no passage of an item; columns as they came."""
    found = stored(leaks(docs, benchmark).select("doc_id").distinct(), "leaks")
    return sized_join(docs, found, ["doc_id"], "left_anti").select(docs.columns)
