"""A Merkle manifest of a table: a content-addressed graph of digests, and proofs by descent from its root.

H is the SHA-256 of its inputs put together, digests as lowercase hex; tables and
shuffles carry a digest as 32 bytes. A row is a leaf. Leaves of a group are ordered
and numbered; every FAN consecutive nodes of a level become the node above. What
remains of each group is a leaf of the tree over groups, whose top is the root. The
manifest keeps one record (digest, children) for each different node, children as one
binary.

A request is the number of a group and of a leaf in it. Requests go down from the root:
their numbers' digits to the base FAN say which child to take, and the children that
aren't taken are one segment of the path. Requests that share leading digits go down
together, once, so no record meets all of them; reversed, the segments are the proof from
the leaf to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.llm.shared import stored

#: Children of a node at most; bytes of a digest.
FAN, BYTES = 16, 32
#: H of no input.
EMPTY = hashlib.sha256().hexdigest()
#: What a leaf is made of.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(x: Column) -> Column:
    """H of binary digests that stand together, as a binary digest."""
    return F.unhex(F.sha2(F.lower(F.hex(x)).cast("binary"), 256))


def shown(x: Column) -> Column:
    """A digest as text."""
    return F.lower(F.hex(x))


def leaf_digest(fields: list[Column]) -> Column:
    """H of the fields, each `-` if null and else its UTF-8 byte count, `:` and its value."""

    def one(c: Column) -> Column:
        said = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(one, fields)).cast("binary"), 256))


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """The rows with s, the number of their group, and r, their number in it, both from 0.

    Groups stand in ascending order, null first; rows of a group ascend by `order`. Rows are
    dealt by ranges of (group, order) and numbered inside a range; a row a range says how many
    groups and rows lie before it. So no task holds a group, and the driver sees no more
    rows than there are tasks.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", __part int, __j long, __i long"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, j, i, last = TaskContext.get().partitionId(), -1, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(batch.schema.get_field_index(group))
            codes = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new = np.ones(n, bool)
            new[1:] = codes[1:] != codes[:-1]
            new[0] = j < 0 or not (keys[0].as_py() == last)
            at = np.flatnonzero(new)
            steps = np.cumsum(new)
            starts = np.concatenate([[-i], at])[steps]  # a group that goes on started i rows before
            count = np.arange(n) - starts
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(j + steps), pa.array(count)], [*batch.schema.names, "__part", "__j", "__i"])
            j, i, last = j + int(steps[-1]), int(count[-1]) + 1, keys[-1].as_py()

    # rows that are equal in all of this may still be dealt to several tasks
    keys = [group, *order, F.monotonically_increasing_id()]
    placed = stored(rows.repartitionByRange(*keys).sortWithinPartitions(group, *order).mapInArrow(made, schema), name)
    key = F.struct(F.col(group).alias("v"))
    place = F.struct("__j", "__i")
    # one row a task
    parts = placed.groupBy("__part").agg(F.min_by(key, place).alias("first"), F.max_by(key, place).alias("last"), F.max(place).alias("top")).orderBy("__part").collect()
    before, held, was, base = [], 0, None, -1
    for p in parts:
        goes_on = was is not None and p["first"]["v"] == was["v"]
        base += 0 if goes_on else 1
        carried = held if goes_on else 0
        before.append((p["__part"], base, carried))
        base, was = base + p["top"]["__j"], p["last"]
        held = p["top"]["__i"] + 1 + (carried if p["top"]["__j"] == 0 else 0)
    offsets = rows.sparkSession.createDataFrame(before, "__part int, __base long, __carried long")
    r = F.col("__i") + F.when(F.col("__j") == 0, F.col("__carried")).otherwise(0)
    return placed.join(F.broadcast(offsets), "__part").select(*rows.columns, (F.col("__base") + F.col("__j")).alias("s"), r.alias("r"))


def _levels(nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame, int]:
    """Records, tops (s, digest, height) and the greatest height of the trees over nodes (s, r, digest)."""
    records, tops, height = [], [], 0
    blob = F.aggregate(F.array_sort(F.collect_list(F.struct("r", "digest"))), F.lit(b""), lambda a, x: F.concat(a, x["digest"]))
    while True:
        up = nodes.groupBy("s", F.expr(f"r div {FAN}").alias("up")).agg(blob.alias("children"))
        up = stored(up.select("s", F.col("up").alias("r"), "children", hashed(F.col("children")).alias("digest")), name)
        # the only node of its level is the top
        alone = (F.col("r") == 0) & (F.octet_length("children") == BYTES)
        tops.append(up.filter(alone).select("s", F.col("children").alias("digest"), F.lit(height).alias("height")))
        nodes = up.filter(~alone)
        if nodes.isEmpty():
            break
        records.append(nodes.select("digest", "children"))
        nodes, height = nodes.select("s", "r", "digest"), height + 1
    none = up.select("digest", "children").limit(0)
    return reduce(DataFrame.union, records, none), reduce(DataFrame.union, tops), height


@dataclass(frozen=True)
class Manifest:
    """`leaves`: the rows' other columns, s, r, digest; `tops`: s, source, digest and height of each group's tree;
    `records`: digest, children; `root` in hex (of nothing, the digest of no input); heights of the highest group's tree and of the tree over groups."""

    leaves: DataFrame
    tops: DataFrame
    records: DataFrame
    root: str
    height: int
    top_height: int


def built(leaves: DataFrame, group: str = "source", order: list[str] | None = None) -> Manifest:
    """The manifest of rows that have a column `digest` (32 bytes); ties in `order` (doc_id) are decided by the digest.

    A null group comes first and is one group; null ids come first. Equal rows are leaves of
    their own. An empty table has no group, and the root is the digest of no input.
    """
    placed = numbered(leaves, group, [*(order or ["doc_id"]), "digest"], "leaves")
    records, tops, height = _levels(placed.select("s", "r", "digest"), "nodes")
    named = placed.filter("r = 0").select("s", group)
    tops = stored(tops.join(named, "s"), "tops")
    over, top, top_height = _levels(tops.select(F.lit(0).cast("long").alias("s"), F.col("s").alias("r"), "digest"), "groups")
    root = top.select(shown(F.col("digest"))).first()
    records = stored(records.union(over).dropDuplicates(["digest"]), "records")
    return Manifest(placed, tops, records, root[0] if root else EMPTY, height, top_height)


def _child(i: Column) -> list[Column]:
    """What a step down takes, and the segment that it leaves, of column children."""
    children = F.col("children")
    at = (i * BYTES).cast("int")
    left, right = F.substring(children, F.lit(1), at), F.substring(children, at + BYTES + 1, F.lit(FAN * BYTES))
    return [F.substring(children, at + 1, F.lit(BYTES)), F.struct(left.alias("left"), right.alias("right"))]


def _down(nodes: DataFrame, wanted: DataFrame, records: DataFrame) -> DataFrame:
    """The nodes (s, p, digest, path) that the numbers in `wanted` (s, r and others) lead to, one step down; r becomes p."""
    met = nodes.join(records, "digest").select("s", F.col("p").alias("__up"), "children", "path")
    steps = wanted.withColumn("__up", F.expr(f"r div {FAN}")).join(met, ["s", "__up"])
    taken, segment = _child(F.col("r") % FAN)
    others = [c for c in wanted.columns if c not in ("s", "r")]
    return steps.select("s", F.col("r").alias("p"), taken.alias("digest"), F.array_append("path", segment).alias("path"), *others)


def _prefixes(requests: DataFrame, height: int) -> list[DataFrame]:
    """The distinct (s, r) of the requests, and of their numbers without 1, 2 .. last digits."""
    out = [requests]
    for _ in range(height):
        out.append(stored(out[-1].select("s", F.expr(f"r div {FAN}").alias("r")).distinct(), "prefixes"))
    return out


def proofs(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """The requests (s, r and any columns but p, digest, path, top) with digest, path and top.

    `path` has a segment for each level from the leaf to the root: what stands left and
    right of the node on the way, as binaries. `top` is the digest of the group's tree.
    Equal requests get a row each; numbers that the manifest doesn't have give none.
    """
    spark = requests.sparkSession
    path = "array<struct<left:binary,right:binary>>"
    start = spark.createDataFrame([(0, 0, bytes.fromhex(manifest.root), [])], f"s long, p long, digest binary, path {path}")
    want = _prefixes(requests.select("s", "r"), manifest.height)
    groups = requests.select("s").distinct().select(F.lit(0).cast("long").alias("s"), F.col("s").alias("r"))
    frontier = start
    for wanted in reversed(_prefixes(groups, manifest.top_height)[: manifest.top_height]):
        frontier = _down(frontier, wanted, manifest.records)
    tops = frontier.select(F.col("p").alias("s"), "digest", F.col("digest").alias("top"), "path").join(manifest.tops.select("s", "height"), "s")
    tops = stored(tops, "found")
    frontier = None
    for level in range(manifest.height, -1, -1):
        here = tops.filter(F.col("height") == level).select("s", F.lit(0).cast("long").alias("p"), "digest", "path", "top")
        if level == manifest.height:
            frontier = here
        else:
            wanted = want[level] if level else requests
            met = _down(frontier.drop("top"), wanted, manifest.records).join(tops.select("s", "top"), "s")
            if level:
                frontier = met.select("s", "p", "digest", "path", "top").union(here)
            else:
                alone = requests.join(here, [here["s"] == requests["s"], here["p"] == requests["r"]]).drop(here["s"], here["p"])
                frontier = met.withColumnRenamed("p", "r").unionByName(alone)
    if manifest.height == 0:
        frontier = requests.join(frontier, [frontier["s"] == requests["s"], frontier["p"] == requests["r"]]).drop(frontier["s"], frontier["p"])
    return frontier.withColumn("path", F.reverse("path"))


def siblings(path: Column) -> Column:
    """All digests of a path, from the leaf's level up and left to right."""
    return F.aggregate(path, F.lit(b""), lambda a, x: F.concat(a, x["left"], x["right"]))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, leaf, lambda a, x: hashed(F.concat(x["left"], a, x["right"])))


def document_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, digest, tampered (what the digest is after lower-casing A-Z in the text, where 5 divides the id's crc32) of each row."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [F.col(c) for c in FIELDS]
    marked = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return docs.select("doc_id", "source", leaf_digest(fields).alias("digest"), F.when(marked, leaf_digest([*fields[:-1], low])).alias("tampered"))


def verified(docs: DataFrame) -> DataFrame:
    """Each row of documents with its place in the manifest, its proof, and whether a tampered copy of it still folds to the root.

    Any field may be null, ids may repeat and sources may be null; further columns are left
    out. A row each; an empty table gives none.
    """
    leaves = stored(document_leaves(docs), "digests")
    manifest = built(leaves)
    found = proofs(manifest, manifest.leaves.select("s", "r", "doc_id", "tampered"))
    out = found.withColumn("__again", folded(F.coalesce("tampered", "digest"), F.col("path")))
    proof = F.sha2(F.lower(F.hex(siblings(F.col("path")))).cast("binary"), 256)
    return out.select("doc_id", shown(F.col("digest")).alias("leaf"), shown(F.col("top")).alias("subroot"), F.lit(manifest.root).alias("root"), proof.alias("proof_sha256"), shown(F.col("__again")).alias("folded_root"), (shown(F.col("__again")) == manifest.root).alias("verified"))
