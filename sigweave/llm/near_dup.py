"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

One fixed permutation scatters the shingles over a circle of cells; a second one,
shifted by k cells, gives signature coordinate k. So the coordinates of a shingle
are neighbours in one array, and a signature is a minimum over rows of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.llm.linking import Bound, linked
from sigweave.llm.shared import bounded_batches, sized_join, stored
from sigweave.llm.words import hashed_words, mixed, shingles

WIDTH = 5
#: Similarity in hundredths.
SIMILARITY = 75
#: Bands and coordinates in each: a pair of similarity 0.75 shares no band with probability 0.000005.
BANDS, ROWS = 32, 4
#: Cells of the circle: many more than the shingles of a text, or the least cells of long unrelated texts would often be equal (which costs time, not results).
CELLS_LOG2 = 22
#: Pairs of one id that one task verifies.
PAIRS_A_TASK = 512
#: Shingles of the first documents of all pairs up to which their sets are broadcast.
BROADCAST_SHINGLES = 1_000_000


class Circle:
    """The two permutations; `signature` takes the distinct shingle hashes of a document."""

    def __init__(self, seed: int = 1) -> None:
        second = np.random.Generator(np.random.PCG64(seed)).permutation(np.arange(1 << CELLS_LOG2, dtype=np.int32))
        n = BANDS * ROWS
        self.shifted = sliding_window_view(np.concatenate([second, second[:n]]), n)

    def signature(self, found: np.ndarray) -> np.ndarray:
        least = np.full(BANDS * ROWS, np.iinfo(np.int32).max, np.int32)
        cells = (mixed(found + np.uint64(7)) >> np.uint64(64 - CELLS_LOG2)).astype(np.int64)
        for at in range(0, len(cells), 1 << 15):
            np.minimum(least, self.shifted[cells[at : at + (1 << 15)]].min(0), out=least)
        return least

    def bands(self, found: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band, in which the band's number counts."""
        rows = self.signature(found).reshape(BANDS, ROWS).astype(np.uint64)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(ROWS):
            key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + rows[:, k])
        return key.view(np.int64)


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, h, at in hashed_words(texts):
        for i in range(len(at) - 1):
            yield np.unique(shingles(h[at[i] : at[i + 1]], WIDTH))


def signatures(docs: DataFrame) -> DataFrame:
    """Columns doc_id, n_shingles, digest (of the whole set, 16 bytes) and bands."""
    bounded_batches(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circle = Circle()
        for batch in batches:
            n, digests, bands = [], [], []
            for found in _sets(batch.column(1)):
                n.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                bands.append(circle.bands(found) if len(found) else np.empty(0, np.int64))
            lengths = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate([*bands, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), keys], ["doc_id", "n_shingles", "digest", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, "doc_id long, n_shingles long, digest binary, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """Columns doc_id and found, the distinct shingle hashes."""
    bounded_batches(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_sets(batch.column(1)))
            at = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            values = pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, values)], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, "doc_id long, found array<long>")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Columns doc_id, n_shingles, component_id, kept: one row for each row of `docs` (doc_id, text).

    Links are pairs whose shingle sets have 100 * intersection >= 75 * union. Sets
    that are equal count as one; of them one row stands for all, so copies in any
    number are neither paired nor gathered. A null or blank text has no shingle and
    is linked with nothing. A null doc_id gets a null component and isn't kept. Rows
    that repeat a doc_id belong to one component. Other columns are ignored.
    """
    own = stored(signatures(docs), "signatures")
    alike = own.filter("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    alike = stored(alike.filter("copies > 1").select("digest", "rep"), "alike")
    own_rep = sized_join(own, alike, ["digest"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    rows = own_rep.filter("n_shingles > 0 and doc_id = rep").select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("info"))

    def shared_with_any(ids: DataFrame) -> DataFrame:
        """The shingles of a document that any other of `ids` has too."""
        some = stored(shingle_sets(sized_join(docs.select("doc_id", "text"), ids.withColumnRenamed("id", "doc_id"), ["doc_id"], "left_semi")).dropDuplicates(["doc_id", "found"]).select("doc_id", F.explode("found").alias("s")), "shingles")
        common = some.groupBy("s").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo != hi").select("s")
        own = some.join(common, "s", "left_semi").groupBy("doc_id").agg(F.collect_set("s").alias("shared"))
        return ids.join(own.withColumnRenamed("doc_id", "id"), "id", "left").select("id", F.coalesce(F.size("shared"), F.lit(0)).cast("long").alias("cap"), F.coalesce("shared", F.array().cast("array<long>")).alias("shared"))

    # similarity s of sizes m and n means s / (1 + s) * (m + n) shingles in common
    def may_link(m, cap, n, other):  # noqa: ANN001, ANN202
        return (100 + SIMILARITY) * F.least(cap, other) >= SIMILARITY * (m + n)

    def may_link_any(m, cap, least):  # noqa: ANN001, ANN202
        return (100 + SIMILARITY) * cap >= SIMILARITY * (m + F.greatest(least, F.ceil(m * SIMILARITY / 100)))

    def similar_sets(m, one, n, two):  # noqa: ANN001, ANN202
        return (100 + SIMILARITY) * F.size(F.array_intersect(one, two)) >= SIMILARITY * (m + n)

    def similar(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs.filter(f"100 * least(a_info, b_info) >= {SIMILARITY} * greatest(a_info, b_info)"), "candidates")
        wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
        sets = stored(shingle_sets(sized_join(docs.select("doc_id", "text"), wanted, ["doc_id"], "left_semi")), "sets")
        a_sets, b_sets = (sets.select(F.col("doc_id").alias(k), F.col("found").alias(f"{k}_set")) for k in ("a", "b"))
        firsts = pairs.select("a", "a_info").distinct()
        if (firsts.agg(F.sum("a_info")).first()[0] or 0) <= BROADCAST_SHINGLES:
            met = pairs.select("a", "b").join(b_sets, "b").join(F.broadcast(a_sets.join(F.broadcast(firsts.select("a")), "a", "left_semi")), "a")
        else:
            # an id of very many pairs meets them in several tasks
            split = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_TASK).cast("int").alias("parts"))
            one = split.join(a_sets, "a").select("a", "a_set", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
            two = pairs.join(split, "a").select("a", "b", F.expr("cast(pmod(xxhash64(b), parts) as int)").alias("part"))
            met = two.join(b_sets, "b").join(one, ["a", "part"])
        both = met.select("a", "b", F.size(F.array_intersect("a_set", "b_set")).alias("n"), (F.size("a_set") + F.size("b_set")).alias("total"))
        return both.filter(f"100 * n >= {SIMILARITY} * (total - n)").select("a", "b")

    comp = stored(linked(rows, similar, Bound(shared_with_any, may_link, may_link_any, similar_sets)), "components")
    out = sized_join(own_rep.select("doc_id", "n_shingles", "rep"), comp.select(F.col("id").alias("rep"), "comp"), ["rep"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "rep")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay: of each component the one of the least doc_id; columns as they came.

    Of rows that repeat a doc_id one stays, whichever task runs again: one with a text
    before those without, then that of the least digest of the text, then that whose
    columns as JSON come first.
    """
    kept = stored(near_duplicates(docs).filter("kept").select("doc_id").distinct(), "kept")
    found = sized_join(docs.filter("doc_id is not null"), kept, ["doc_id"], "left_semi")
    repeated = stored(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if not repeated.isEmpty():
        first = F.struct(F.col("text").isNull(), F.sha2("text", 256), F.to_json(F.struct(*columns)))
        again = sized_join(found, repeated, ["doc_id"], "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*columns), first).alias("__row")).select("__row.*")
        found = sized_join(found, repeated, ["doc_id"], "left_anti").select(columns).union(again)
    return found.select(columns).union(docs.filter("doc_id is null"))
