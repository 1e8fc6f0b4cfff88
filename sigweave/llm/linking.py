"""From rows (key, id) that share keys to classes of ids linked by an exact test.

All pairs of a key are never made at once. First each key's least id meets the
others (of a key with very many ids, each part's least id does, and these meet the
key's); the tested pairs give components. Two further rounds do so with other
ids, and only against ids of other components. Last, the pairs that still lie in
different components of a key and weren't tested meet. No pair that could join
two components goes untested, so the components are those of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigweave.llm.shared import BROADCAST_ROWS, stored

#: Keys are looked for that hold one in HOT_ONE_IN of the rows (HOT_ONE_IN keys at most) and HOT_LEAST sampled rows,
#: among one in SAMPLED_ONE_IN ids; the rows of such a key are dealt over SALTS tasks. This decides on the plan alone.
SAMPLED_ONE_IN, HOT_ONE_IN, HOT_LEAST, SALTS = 16, 20_000, 32, 256

Test = Callable[[DataFrame], DataFrame]


def components(edges: DataFrame) -> DataFrame:
    """Columns id, comp: the least id that links (a, b) reach from each id that has a link.

    Alternates two steps until nothing changes: an id's larger neighbours move to
    its least neighbour, then its smaller ones do. Each step is a grouped minimum
    (combined before the shuffle) and a join; every round is written and read again.
    """

    def stars(e: DataFrame, larger: bool, few: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a"))) if larger else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # a written table on either side lets the join split an id of very many neighbours
        met = both.join(F.broadcast(least) if few else stored(least, "least").hint("merge"), "a")
        if larger:
            moved = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return moved.filter("a != b")

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    edges = stored(edges.select("a", "b").filter("a != b").distinct(), "edges")
    was = mark(edges)
    while was[0]:
        few = 2 * was[0] <= BROADCAST_ROWS
        moved = stars(edges, True, few)
        edges = stored(stars(moved if few else stored(moved, "moved"), False, few).distinct(), "edges")
        now = mark(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())


@dataclass(frozen=True)
class Bound:
    """What shows early that ids can't be linked.

    `caps` gets a frame of ids and returns id, cap, shared: what an id has in common
    with any other of the frame, and how much that is. `pair(info, cap, info, cap)` says
    whether two ids may be linked; `any_of(info, cap, least)` whether one may be linked
    with any id whose info is at least `least`; both only rule out what is impossible.
    `exact(info, shared, info, shared)` says whether two ids are linked, or, where
    `sure` is false, whether they may be, and those that may are tested.
    """

    caps: Callable[[DataFrame], DataFrame]
    pair: Callable[[Column, Column, Column, Column], Column]
    any_of: Callable[[Column, Column, Column], Column]
    exact: Callable[[Column, Column, Column, Column], Column]
    sure: bool = True


def hot_keys(rows: DataFrame) -> DataFrame:
    """Column key: the keys of very many rows, HOT_ONE_IN at most, found in a hashed sample of the ids."""
    some = stored(rows.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(SAMPLED_ONE_IN)) == 0).groupBy("key").agg(F.count("*").alias("n")).filter("n >= 2"), "counts")
    total = some.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return stored(some.filter(F.col("n") >= max(HOT_LEAST, -(-total // HOT_ONE_IN))).select("key"), "hot")


def linked(rows: DataFrame, test: Test, bound: Bound | None = None, rounds: int = 1) -> DataFrame:
    """Columns id, comp of the ids with a link; `rows` has key, id, info (what `test` may use to sort pairs out early).

    `test` gets distinct pairs a, b, a_info, b_info and returns the a, b that are linked.
    Rows with a null key must not occur; an id may have a key twice.
    """
    # a part of a hot key meets the part's least id, and these meet the least one of the key
    hot = hot_keys(rows)
    dealt = rows.join(F.broadcast(hot.select("key", F.lit(True).alias("hot"))), "key", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0))
    part = W.partitionBy("key", "salt")
    dealt = dealt.withColumn("p", F.min(F.struct("id", "info")).over(part)).withColumn("q", F.max("id").over(part))
    met = stored(dealt.filter("hot or p.id != q").select("key", "id", "info", "p", "hot"), "shared")

    def open_rows(now: DataFrame, step: int, most_done: int) -> DataFrame:
        """The rows of keys with more than one component and more than `most_done` ids, and an id of the key as p."""
        pivot = F.min_by(F.struct("id", "info", "cap", "comp"), F.xxhash64("id", F.lit(step))).alias("p")
        keys = now.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("info").alias("least"), pivot)
        return now.join(keys.filter(f"n > {most_done} and lo != hi").select("key", "p", "least"), "key")

    def sides(x: str, y: str) -> list[Column]:
        ordered = [F.least(f"{x}.id", f"{y}.id").alias("a"), F.greatest(f"{x}.id", f"{y}.id").alias("b")]
        return [*ordered, F.expr(f"if({x}.id < {y}.id, {x}.info, {y}.info)").alias("a_info"), F.expr(f"if({x}.id < {y}.id, {y}.info, {x}.info)").alias("b_info")]

    pairs = met.filter("p.id != id").select(F.col("p.id").alias("a"), F.col("id").alias("b"), F.col("p.info").alias("a_info"), F.col("info").alias("b_info"))
    heads = met.filter("hot").select("key", "p").distinct()
    heads = heads.join(F.broadcast(heads.groupBy("key").agg(F.min("p").alias("top"))), "key").filter("p.id != top.id")  # HOT_ONE_IN keys at most
    pairs = pairs.union(heads.select("top.id", "p.id", "top.info", "p.info"))
    pairs = stored(pairs.dropDuplicates(["a", "b"]), "pairs")
    tested = pairs.select("a", "b")
    found = stored(test(pairs).select("a", "b").distinct(), "links")
    comp = components(found)
    left = met.select("key", "id", "info").distinct().withColumn("cap", F.lit(None).cast("long"))
    for step in range(1, rounds + 2):
        now = left.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        # the round before had one id of the key meet all others of these rows, so two ids are done
        now = open_rows(now, step, 2)
        if bound:
            if step == 1:
                now = stored(now, "met")
                capped = stored(bound.caps(stored(now.select("id").distinct(), "ids")), "capped")
                now = now.drop("cap").join(capped.select("id", "cap"), "id")
            # who can't be linked with anyone of its key leaves it, which may settle the key;
            # if the id that met the others has left, two that stay haven't met
            now = open_rows(now.filter(bound.any_of(F.col("info"), F.col("cap"), F.col("least"))).drop("p", "least"), step, 1)
        now = stored(now.select("key", "id", "info", "cap", "comp", "p"), "open")
        left = now.select("key", "id", "info", "cap")
        if now.isEmpty():
            break
        if step > rounds and bound:
            # few are left; what they share decides, inside the join
            row = F.struct("id", "info", "cap", "comp", "shared")
            now = now.join(capped.select("id", "shared"), "id")
            one, two = now.select("key", row.alias("x")), now.select("key", row.alias("y"))
            met_now = one.join(two, (one["key"] == two["key"]) & F.expr("x.id < y.id and x.comp != y.comp") & bound.pair(F.col("x.info"), F.col("x.cap"), F.col("y.info"), F.col("y.cap")) & bound.exact(F.col("x.info"), F.col("x.shared"), F.col("y.info"), F.col("y.shared")))
            good = stored((met_now.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")) if bound.sure else met_now.select(*sides("x", "y"))).dropDuplicates(["a", "b"]), "links")
            good = good if bound.sure else stored(test(good).select("a", "b"), "links")
            return comp if good.isEmpty() else components(found.union(good))
        row = F.struct("id", "info", "cap", "comp")
        if step <= rounds:
            met_now = now.select(row.alias("x"), F.col("p").alias("y")).filter("x.comp != y.comp")
        else:
            one, two = now.select("key", row.alias("x")), now.select("key", row.alias("y"))
            met_now = one.join(two, (one["key"] == two["key"]) & F.expr("x.id < y.id and x.comp != y.comp"))
        if bound:
            met_now = met_now.filter(bound.pair(F.col("x.info"), F.col("x.cap"), F.col("y.info"), F.col("y.cap")))
        pairs = stored(met_now.select(*sides("x", "y")).dropDuplicates(["a", "b"]).join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        tested = tested.union(pairs.select("a", "b"))
        good = stored(test(pairs).select("a", "b").distinct(), "links")
        if good.isEmpty():
            continue
        found = found.union(good)
        comp = components(found)
    return comp
