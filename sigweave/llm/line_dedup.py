"""Removal of repeated and nearly repeated lines by a segment-partition edit join.

A line is cut into `edits + 1` segments. A line within `edits` edits of it holds
one of them unchanged, at a place that the lengths and the segment's number bound;
so lines meet by the hash of (length, segment number, segment), and those that meet
are verified by an edit distance whose band of the matrix is kept in two integers.
All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.llm.linking import Bound, linked
from sigweave.llm.shared import sized_join, stored

EDITS = 2
#: Shorter lines are compared for equality alone: two edits in them are often another number or name.
LEAST_CHARS = 25
#: Characters of the pieces that sort pairs out before they are verified.
FINE = 4
#: Characters of the pieces that show what of a line no other has.
GRAM = 8
#: Sizes of the pieces whose parities sort pairs out before they are compared.
SKETCHED = (1, 2, 3)
#: Characters that regular expressions see as two.
ASTRAL = r"[\x{10000}-\x{10FFFF}]"
#: A line that is more than one in so many of all is met by its first copy alone.
HOT_ONE_IN = 1000


def segment_keys(line: Column, cuts: list[Column], edits: int) -> Column:
    """Hashes (length, segment number, segment) by which a line meets those up to `edits` edits away that aren't longer.

    `cuts` are those of `segment_cuts`. With a length that is `less` shorter, segment k
    of the other line can lie where the edits left of it, and those right of it, leave
    it (both bounds hold, since some segment has at most k - 1 edits to its left and
    edits + 1 - k to its right). The numbers are small and are hashed in by an exclusive
    or, so that the generated code stays small enough to be compiled.
    """
    keys, parts, at = [], edits + 1, iter(cuts)
    for less in range(edits + 1):
        n = F.length(line) - less
        ends = [F.lit(0), *(next(at) for _ in range(edits)), n]
        for k in range(1, parts + 1):
            for shift in range(max(-(k - 1), less - (parts - k)), min(k - 1, less + parts - k) + 1):
                segment = F.substring(line, ends[k - 1] + (shift + 1), ends[k] - ends[k - 1])
                keys.append(F.xxhash64(segment).bitwiseXOR(F.shiftleft((n * (parts + 1) + k).cast("long"), 24)))
    return F.array(*keys)


def segment_cuts(lines: DataFrame, edits: int) -> tuple[DataFrame, list[Column]]:
    """The lines with columns that say where the segments of a line of this length, and of each shorter one, end; and these columns."""
    cuts = {f"cut{less}_{k}": F.expr(f"cast((length(line) - {less}) * {k} div {edits + 1} as int)") for less in range(edits + 1) for k in range(1, edits + 1)}
    return lines.withColumns(cuts), [F.col(c) for c in cuts]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, in which the value is computed once however often it occurs."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def may_be_within(a: Column, b: Column, edits: int) -> Column:
    """Whether all but `edits` of some pieces of `a` occur in `b`, each moved by `edits` at most: cheap, and true of every pair within that distance."""
    pieces = 3 * edits + 2
    n = F.length(a)
    met = F.lit(0)
    for k in range(pieces):
        start, end = F.floor(n * k / pieces).cast("int"), F.floor(n * (k + 1) / pieces).cast("int")
        first = F.greatest(start - edits, F.lit(0))
        met = met + F.contains(F.substring(b, first + 1, end + edits - first), F.substring(a, start + 1, end - start)).cast("int")
    # then pieces of FINE characters, so that a changed word spoils more of them than the edits can
    spoiled = F.filter(F.sequence(F.lit(0), F.floor(n / FINE).cast("int") - 1), lambda k: ~F.contains(F.substring(b, F.greatest(k * FINE - edits, F.lit(0)) + 1, k * 0 + FINE + 2 * edits), F.substring(a, k * FINE + 1, F.lit(FINE))))
    return (F.abs(n - F.length(b)) <= edits) & (met >= pieces - edits) & ((n < FINE) | (F.size(spoiled) <= edits))


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two strings is at most `edits`.

    The band holds the 2 * edits + 1 cells of a column of the matrix about the
    diagonal, as the signs of their vertical differences (two integers). First the
    distance is followed along the band's lower edge, then along the last row.
    """
    full = (1 << (2 * edits + 1)) - 1
    long = lambda v: F.lit(v).cast("long")
    cut = lambda v: v.bitwiseAND(long(full))
    bit = lambda v, at: F.getbit(v, at).cast("int")

    def equal(s: Column) -> Column:
        """For each character of b the cells of its band where a has the same."""

        def of(char: Column, i: Column) -> Column:
            cells = [F.when(F.get(s["p"], i + (k - edits)) == char, long(1 << k)).otherwise(long(0)) for k in range(2 * edits + 1)]
            return reduce(Column.__add__, cells)

        return F.transform(s["t"], of)

    def step(acc: Column, same: Column) -> Column:
        d0 = cut(same.bitwiseAND(acc["vp"]) + acc["vp"]).bitwiseXOR(acc["vp"]).bitwiseOR(same).bitwiseOR(acc["vn"])

        def across(d: Column) -> Column:
            return let(F.struct(d.alias("d0"), cut(acc["vn"].bitwiseOR(F.bitwise_not(d.bitwiseOR(acc["vp"])))).alias("hp"), d.bitwiseAND(acc["vp"]).alias("hn")), down)

        def down(s: Column) -> Column:
            half = F.shiftright(s["d0"], 1)
            row = F.greatest(acc["n"] - 1 - acc["i"] + edits, F.lit(0))  # the matrix' last row in the band
            far = F.when(acc["i"] < acc["n"] - edits, 1 - bit(s["d0"], F.lit(2 * edits))).otherwise(bit(s["hp"], row) - bit(s["hn"], row))
            return F.struct(cut(s["hn"].bitwiseOR(F.bitwise_not(half.bitwiseOR(s["hp"])))).alias("vp"), half.bitwiseAND(s["hp"]).alias("vn"), acc["n"].alias("n"), (acc["far"] + far).alias("far"), (acc["i"] + 1).alias("i"))

        return let(d0, across)

    begin = F.struct(long(full - ((1 << edits) - 1)).alias("vp"), long(0).alias("vn"), F.length(a).alias("n"), F.lit(edits).alias("far"), F.lit(0).alias("i"))
    masks = let(F.struct(F.split(a, "").alias("p"), F.split(b, "").alias("t")), equal)
    distance = F.aggregate(masks, begin, step, lambda acc: acc["far"])
    return (F.abs(F.length(a) - F.length(b)) <= edits) & (F.length(a) > edits) & (F.length(b) > 0) & (distance <= edits)


def grams(line: Column, size: int) -> Column:
    """All pieces of `size` characters, one from each place (a character outside the basic plane has two places)."""
    return F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def least_edits(lines: DataFrame) -> DataFrame:
    """Columns id, line, cap of lines (id, line): so many edits at least would make a line another one of these.

    They must touch every piece of GRAM characters that no other line has, and an edit
    touches pieces that start within GRAM characters alone. Where places aren't
    characters, the cap is 0.
    """
    found = lines.select("id", F.posexplode(grams(F.col("line"), GRAM)).alias("pos", "gram")).select("id", "pos", F.xxhash64("gram").alias("gram"))
    lone = found.groupBy("gram").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.min("pos").alias("pos")).filter("id = last")
    lone = lone.groupBy("id").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    touched = lambda acc, x: F.when(x >= acc["end"], F.struct((acc["n"] + 1).alias("n"), (x + GRAM).alias("end"))).otherwise(acc)
    need = F.aggregate("at", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), touched, lambda acc: acc["n"])
    cap = F.when(F.col("line").rlike(ASTRAL), 0).otherwise(F.coalesce(need, F.lit(0)))
    return lines.join(lone, "id", "left").select("id", "line", cap.cast("long").alias("cap"))


def sketch(line: Column) -> Column:
    """For each size of SKETCHED 64 bits: whether a line has an odd number of pieces with this hash."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    return F.struct(*(F.aggregate(grams(line, k), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(bit(x))).alias(f"of{k}") for k in SKETCHED))


def sketches_agree(a: Column, b: Column, edits: int) -> Column:
    """True of the sketches of all lines within `edits` edits: one takes at most k pieces of k characters away and brings k. A null agrees with all."""
    return F.coalesce(reduce(Column.__and__, (F.bit_count(a[f"of{k}"].bitwiseXOR(b[f"of{k}"])) <= 2 * k * edits for k in SKETCHED)), F.lit(True))


def _lines(docs: DataFrame) -> DataFrame:
    """Columns doc_id, pos, line, id, id2 of the lines that have a word."""
    lines = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.filter(r"line rlike '[^\\x20\\x09-\\x0D]'").withColumns({"id": F.xxhash64("line"), "id2": F.xxhash64(F.lit("2"), "line")})


def repeated_lines(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Columns doc_id, pos: the lines (by number, from 0) that repeat an earlier one.

    Lines that are equal form classes, whatever their length; those of `least_chars`
    characters or more are also linked up to `edits` edits. The line that is first by
    (doc_id, pos) of each class isn't returned. Lines without a word are left alone.
    """
    least_chars = max(least_chars, 2 * (edits + 1))
    lines = _lines(docs)
    own = stored(lines.select("doc_id", "pos", "id", "id2"), "lines")
    place = F.struct("doc_id", "pos")
    first = stored(own.groupBy("id", "id2").agg(F.min(place).alias("first"), F.count("*").alias("n")), "first")
    many = max(1000, own.count() // HOT_ONE_IN)
    hot = stored(first.filter(F.col("n") >= many).select("id", "id2", "first"), "hot")  # HOT_ONE_IN rows at most
    long_lines = lines.filter(F.length("line") >= least_chars)
    rows = long_lines.join(F.broadcast(hot), ["id", "id2"], "left").filter(F.col("first").isNull() | (F.col("first") == place))
    rows, cuts = segment_cuts(rows.select("id", "line"), edits)
    rows = rows.select(F.explode(segment_keys(F.col("line"), cuts, edits)).alias("key"), "id", F.lit(0).cast("tinyint").alias("info"))

    texts: list[DataFrame] = []

    def close(pairs: DataFrame) -> DataFrame:
        if not texts:  # the first pairs hold all ids that later ones can have
            wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
            found = sized_join(long_lines, wanted, ["id"], "left_semi").groupBy("id").agg(F.min("line").alias("line"))
            texts.append(stored(found, "texts"))
        one, two = (texts[0].select(F.col("id").alias(k), F.col("line").alias(f"{k}_line")) for k in ("a", "b"))
        return pairs.select("a", "b").join(one, "a").join(two, "b").filter(near(F.col("a_line"), F.col("b_line"))).select("a", "b")

    def near(a: Column, b: Column) -> Column:
        return may_be_within(a, b, edits) & within_edits(a, b, edits)

    def seen(ids: DataFrame) -> DataFrame:
        of = F.when((F.col("cap") <= edits) & ~F.col("line").rlike(ASTRAL), sketch(F.col("line")))
        return least_edits(ids.join(texts[0], "id")).select("id", "cap", of.alias("shared"))

    bound = Bound(seen, lambda *_: F.lit(True), lambda _, cap, __: cap <= edits, lambda _, a, __, b: sketches_agree(a, b, edits), sure=False)
    comp = stored(linked(rows, close, bound), "classes")
    known = sized_join(first, comp, ["id"], "left")
    heads = known.filter("comp is not null").groupBy("comp").agg(F.min("first").alias("head"))
    known = sized_join(known.filter("n > 1 or comp is not null"), stored(heads, "heads"), ["comp"], "left")
    known = stored(known.select("id", "id2", F.coalesce("head", "first").alias("first")), "decided")
    return own.join(known, ["id", "id2"]).filter(place != F.col("first")).select("doc_id", "pos")


def free_name(name: str, taken: list[str]) -> str:
    """The name, with as many underscores behind it as make it new."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def count_names(columns: list[str]) -> tuple[str, str]:
    """What `dedup_lines` calls its counts beside these columns: n_lines and n_removed, or names near them if they are taken."""
    return free_name("n_lines", columns), free_name("n_removed", columns)


def dedup_lines(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The documents without repeated lines, and n_lines, n_removed.

    Every row of `docs` (doc_id, text, and any other columns) is returned; `text` lacks
    the lines of `repeated_lines`, the rest is joined by line ends again. A null text
    stays null and has no line; an empty one has one. Rows that repeat a doc_id count
    as one document, so one doesn't take the other's lines; a row without doc_id stays
    as it is and takes no other's lines. A column n_lines or n_removed that `docs` has
    already stays; the count then has the name that `count_names` gives.
    """
    names = count_names(docs.columns)
    own_id, gone = free_name("__id", docs.columns), free_name("__removed", docs.columns)
    removed = repeated_lines(docs, edits, least_chars).groupBy("doc_id").agg(F.collect_set("pos").alias("pos"))
    removed = removed.select(F.col("doc_id").alias(own_id), F.col("pos").alias(gone))
    out = docs.join(removed, docs["doc_id"].cast("long") == removed[own_id], "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(F.split("text", "\n")) - 1), F.col(gone))
    kept = let(F.split("text", "\n"), lambda lines: F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    counts = {names[0]: F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))), names[1]: F.coalesce(F.size(gone), F.lit(0))}
    text = F.when(F.col(gone).isNotNull(), kept).otherwise(F.col("text")).alias("text")
    return out.select(*(text if c == "text" else docs[c] for c in docs.columns), *(v.alias(k) for k, v in counts.items()))
