"""Personal data in texts: rules, loose candidates, and boosted trees that choose among these.

The rules' spans always stay. Beside them, generators of high recall propose spans
that may overlap. Trees over the format and the surroundings of a candidate score
it; the scores of each kind are calibrated to probabilities on held-out candidates,
and a threshold on these selects what is added. All work on the tables is DataFrame
expressions; only the trees' fit, on a bounded sample of candidates' features, runs
in the driver.

The trees learn from the corpus' own personal data. Each span that a rule finds is
rewritten, where it stands, in the ways that such data are often disguised
(positives), and in ways that break what makes it personal data: another check
digit, a part over 255, too few digits (negatives). Candidates in the texts whose
plain form no rule accepts are negatives too; those whose plain form a rule accepts
are what the method looks for, and teach nothing. Trees see the documents of one
hashed half, without one form of each kind; the other half, with all forms,
calibrates.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.llm.line_dedup import let
from sigweave.llm.shared import hashed_share, stored

KINDS = ("email", "ip", "card", "phone")
#: The rules' patterns. Starts and repetitions are written so that no text makes the
#: matcher go back or recurse: a local part starts where its characters do, or where
#: the last match ended; runs of digits are taken whole.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of candidates, several for a kind; what they propose may overlap.
LOOSE = {
    "email": [
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\)|\{dot\})\x20?[A-Za-z0-9-]++)++",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++",
    ],
    "ip": [r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)|,|\x20\.\x20|\[dot\])[0-9]{1,3}){3}(?![0-9])"],
    "card": [r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}[0-9]){12,18}(?![0-9])"],
    "phone": [r"(?<![0-9])(?:\+|00|\()\x20?[0-9][0-9\x20()./-]{6,20}[0-9](?![0-9])", r"(?<![0-9])\(?[0-9]{3}\)?[\x20./-][0-9]{3}[\x20./-][0-9]{4}(?![0-9])"],
}
#: Only texts with such a character can hold a kind.
NEEDS = {"email": r"@|[\[({]at[\])}]|\x20at\x20", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
#: Documents that training looks at, in expectation (all, if there are no more); boosting's parameters; the probability from which a candidate is added.
SAMPLED, TREES, RATE, LEAF, PROBABLE = 20_000, 24, 0.3, 10, 0.9
#: What holds for a kind of data comes first, so that it wins where several features part the examples alike.
FEATURES = ("luhn", "octets", "names_end", "digits", "has_letters", "at", "plus", "zeros", "sticks_left", "sticks_right", "said_before", "brackets", "groups", "dots", "dashes", "spaces", "kind")
#: Surroundings in characters, and words that announce personal data.
AROUND = 12
HINTS = r"(?i)mail|phone|tel|call|card|contact|\bip\b|addr|fax|visa"
#: Matches whose places are summed up at a time.
PART = 128
#: What `spans` returns.
NONE = "array<struct<start:int,end:int,s:string,before:string,after:string>>"


def spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, s, before, after) of a pattern's matches, leftmost and not overlapping; code points, end exclusive.

    Places are sums of lengths, taken part by part, so that the work is near linear in
    the matches. `before` and `after` are up to AROUND characters beside a match, back
    to the start of the match before it and on to the end of the next one; so no match
    is looked up in the whole text again.
    """
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("rest"))
    found = NONE

    def one(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["s"])
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end"), *(x[k].alias(k) for k in ("s", "before", "after"))))).alias("found"))

    def placed(met: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(met) - 1) / PART).cast("int")), lambda k: F.slice(met, k * PART + 1, F.lit(PART)))
        return let(parts, joined)

    def joined(parts: Column) -> Column:
        size = lambda p: F.aggregate(p, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["s"]))
        starts = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.get(acc, F.size(acc) - 1) + size(p))))
        begin = lambda at: F.struct(at.alias("at"), F.array().cast(found).alias("found"))
        return F.flatten(F.zip_with(parts, F.slice(starts, F.lit(1), F.size(parts)), lambda p, at: F.aggregate(p, begin(at), one, lambda acc: acc["found"])))

    def beside(b: Column) -> Column:
        def one_hit(s: Column, i: Column) -> Column:
            near = lambda row, k: F.coalesce(F.get(row, k), F.lit(""))
            before = F.right(F.concat(near(b["hits"], i - 1), near(b["rest"], i)), F.lit(AROUND))
            after = F.left(F.concat(near(b["rest"], i + 1), near(b["hits"], i + 1)), F.lit(AROUND))
            return F.struct(near(b["rest"], i).alias("gap"), s.alias("s"), before.alias("before"), after.alias("after"))

        return F.transform(b["hits"], one_hit)

    met = let(both, beside)
    return let(met, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(F.array().cast(found)))


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit is right: from the right every second digit counts twice, its own digits summed."""
    worth = F.transform(F.split(F.reverse(digits), ""), lambda c, i: (c.cast("int") * (1 + i % 2)) - F.when((i % 2 == 1) & (c.cast("int") > 4), 9).otherwise(0))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(digits_of(s))
    if kind == "card":
        return n.between(13, 19) & F.when(n.between(13, 19), luhn(digits_of(s))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _numbered(hits: Column, fields: tuple[str, ...], **numbers: int) -> Column:
    """The matches with their kind's number, some of their fields, and further numbers."""
    return F.transform(hits, lambda x: F.struct(F.lit(numbers["kind"]).alias("kind"), *(x[k].alias(k) for k in fields), *(F.lit(v).alias(k) for k, v in numbers.items() if k != "kind")))


def base_spans(text: Column, *around: str) -> Column:
    """What the rules find: an array of (kind, start, end, s), with `before` and `after` if they are named."""

    def of(kind: str) -> Column:
        hits = F.filter(spans(text, RULES[kind]), lambda x: valid(kind, x["s"]))
        return F.coalesce(F.when(text.rlike(NEEDS[kind]), hits), F.array().cast(NONE))

    return F.concat(*(_numbered(of(k), ("start", "end", "s", *around), kind=i) for i, k in enumerate(KINDS)))


#: Kind and pattern of each generator.
GENERATORS = [(i, g) for i, k in enumerate(KINDS) for g in LOOSE[k]]


def candidates(text: Column) -> Column:
    """What the generators propose: an array of (kind, start, end, s, before, after, by).

    `by` numbers the generator, whose own proposals ascend and don't overlap; those of
    different ones may, and may be equal.
    """

    def of(by: int, kind: int, pattern: str) -> Column:
        hits = F.coalesce(F.when(text.rlike(NEEDS[KINDS[kind]]), spans(text, pattern)), F.array().cast(NONE))
        return _numbered(hits, ("start", "end", "s", "before", "after"), kind=kind, by=by)

    return F.concat(*(of(by, kind, pattern) for by, (kind, pattern) in enumerate(GENERATORS)))


def plain(kind: Column, s: Column) -> Column:
    """A candidate as the rules would have it: signs for what is spelled out, no blanks beside them, one kind of separator."""
    email = F.regexp_replace(F.regexp_replace(s, r"\x20?(?:[\[({]at[\])}]|\x20at\x20)\x20?", "@"), r"\x20?(?:[\[({]dot[\])}]|\x20dot\x20)\x20?", ".")
    ip = F.regexp_replace(s, r"[^0-9]+", ".")
    phone = F.concat(F.lit("+"), F.regexp_replace(digits_of(s), "^00", ""))
    return F.when(kind == 0, F.regexp_replace(email, r"\x20", "")).when(kind == 1, ip).when(kind == 2, digits_of(s)).otherwise(phone)


def accepted(kind: Column, s: Column) -> Column:
    """Whether a rule would take the whole of a plain form."""
    whole = [s.rlike(f"^(?:{RULES[k]})$") & valid(k, s) for k in KINDS]
    return F.when(kind == 0, whole[0]).when(kind == 1, whole[1]).when(kind == 2, whole[2]).otherwise(whole[3])


def count_below(row: Column, value: Callable[[Column], Column], bound: Column) -> Column:
    """How many of a row's ascending values are less than the bound, found by halving."""
    middle = lambda acc: F.shiftright(acc["lo"] + acc["hi"], 1)

    def halved(acc: Column, _: Column) -> Column:
        upper, lower = F.struct((middle(acc) + 1).alias("lo"), acc["hi"].alias("hi")), F.struct(acc["lo"].alias("lo"), middle(acc).alias("hi"))
        return F.when(acc["lo"] >= acc["hi"], acc).when(value(F.get(row, middle(acc))) < bound, upper).otherwise(lower)

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(row) + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(row).alias("hi")), halved, lambda acc: acc["lo"])


def parted(found: Column, by: str, n: int) -> Column:
    """A struct of n arrays p0, p1 ...: the spans of each number in the field `by`."""
    of = lambda i: F.filter(found, lambda x: x[by] == i)
    return F.struct(*(of(i).alias(f"p{i}") for i in range(n)))


def apart(loose: Column, base: Column) -> Column:
    """The candidates that overlap no rule's span; each is held against the last span of each kind that starts before its end."""

    def free(c: Column, row: Column) -> Column:
        last = F.get(row, count_below(row, lambda x: x["start"], c["end"]) - 1)
        return F.coalesce(last["end"] <= c["start"], F.lit(True))

    return let(parted(base, "kind", len(KINDS)), lambda rows: F.filter(loose, lambda c: reduce(Column.__and__, (free(c, rows[f"p{i}"]) for i in range(len(KINDS))))))


def likeliest(scored: Column, rank: Callable[[Column], Column]) -> Column:
    """Of scored candidates (`c` and `by` among their fields) those that overlap none of a higher rank.

    The proposals of one generator don't overlap, so those that overlap a candidate
    stand side by side; over all candidates they are as many as both lists together.
    """

    def beaten(j: Column, row: Column) -> Column:
        start, end = count_below(row, lambda x: x["c"]["end"], j["c"]["start"] + 1), count_below(row, lambda x: x["c"]["start"], j["c"]["end"])
        met = F.struct(start.alias("start"), end.alias("end"))
        return let(met, lambda m: F.when(m["start"] < m["end"], F.exists(F.sequence(m["start"], m["end"] - 1), lambda k: rank(F.get(row, k)) > rank(j))).otherwise(F.lit(False)))

    def of(rows: Column) -> Column:
        return F.filter(scored, lambda j: ~reduce(Column.__or__, (beaten(j, rows[f"p{i}"]) for i in range(len(GENERATORS)))))

    return let(parted(scored, "by", len(GENERATORS)), of)


#: Four numbers of at most 255, whatever stands between them.
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:[^0-9]+|$)){4}$"


def features(kind: Column, s: Column, before: Column, after: Column) -> list[Column]:
    """Format and surroundings of a candidate, in the order of FEATURES."""
    count = lambda chars: (F.length(s) - F.length(F.regexp_replace(s, chars, ""))).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return [
        flag(valid("card", s)), flag(s.rlike(OCTETS)), flag(s.rlike("[A-Za-z]{2,}$")), count("[0-9]"), flag(s.rlike("[A-Za-z]")), flag(F.contains(s, F.lit("@"))), flag(s.startswith("+")), flag(s.startswith("00")),
        flag(F.right(before, F.lit(1)).rlike(r"[A-Za-z0-9=\"]")), flag(F.left(after, F.lit(1)).rlike(r"[A-Za-z0-9\"]")), flag(before.rlike(HINTS)),
        count(r"[()\[\]{}]"), F.size(F.split(s, "[^A-Za-z0-9]+")).cast("double"), count(r"\."), count("-"), count(" "), kind.cast("double"),
    ]


@dataclass
class Tree:
    """A feature and a cut, then one of each side's own, and four leaves; None: the side isn't split."""

    top: tuple[int, float]
    sides: list[tuple[int, float] | None]
    leaves: list[list[float]]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        right = x[:, self.top[0]] > self.top[1]
        for side, split in enumerate(self.sides):
            here = right == bool(side)
            deep = x[:, split[0]] > split[1] if split else np.zeros(len(x), bool)
            out[here] = np.where(deep[here], self.leaves[side][1], self.leaves[side][0])
        return out

    def column(self, f: list[Column]) -> Column:
        def leaf(side: int) -> Column:
            one, two = (F.lit(float(v)) for v in self.leaves[side])
            return F.when(f[self.sides[side][0]] > self.sides[side][1], two).otherwise(one) if self.sides[side] else one

        return F.when(f[self.top[0]] > self.top[1], leaf(1)).otherwise(leaf(0))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, w: np.ndarray, at: np.ndarray) -> tuple[int, float] | None:
    """The cut that most raises the second-order gain of the rows `at`, which count `w` times each."""
    best, most = None, 1e-6
    total = g[at].sum() ** 2 / (h[at].sum() + 1)
    for k in range(x.shape[1]):
        for cut in np.unique(x[at, k])[:-1]:
            left = at & (x[:, k] <= cut)
            right = at & ~left
            if min(w[left].sum(), w[right].sum()) >= LEAF:
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1) - total
                if gain > most:
                    best, most = (k, float(cut)), gain
    return best


@dataclass
class Chooser:
    """For each kind its trees, the score they start from, and the slope and offset that turn a score into log odds (None where too few candidates were held out: nothing of the kind is added)."""

    trees: list[list[Tree]]
    starts: list[float]
    odds: list[tuple[float, float] | None]

    def score(self, kind: int, x: np.ndarray) -> np.ndarray:
        return self.starts[kind] + sum((t.score(x) for t in self.trees[kind]), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated, by the kind in the last feature; 0 where nothing was calibrated."""
        z = np.full(len(x), -40.0)
        for kind, o in enumerate(self.odds):
            at = x[:, -1] == kind
            if o:
                z[at] = o[0] * self.score(kind, x[at]) + o[1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def probability_column(self, f: list[Column]) -> Column:
        z = F.lit(-40.0)
        for kind, o in enumerate(self.odds):
            if o:
                score = sum((t.column(f) for t in self.trees[kind]), F.lit(float(self.starts[kind])))
                z = F.when(f[-1] == kind, score * o[0] + o[1]).otherwise(z)
        return 1 / (1 + F.exp(-z))

    @classmethod
    def fitted(cls, x: np.ndarray, y: np.ndarray, held: np.ndarray, w: np.ndarray | None = None) -> Chooser:
        """Boosts trees of depth two for each kind on the rows that aren't held out; these calibrate. A row counts `w` times (once, if none are given)."""
        w = np.ones(len(y)) if w is None else w
        model = cls([[] for _ in KINDS], [0.0] * len(KINDS), [None] * len(KINDS))
        for kind in range(len(KINDS)):
            own = x[:, -1] == kind
            model._boost(kind, x[own & ~held], y[own & ~held], w[own & ~held])
            at = own & held
            if min(w[at & (y == 1)].sum(), w[at & (y == 0)].sum()) >= LEAF:
                model.odds[kind] = _platt(model.score(kind, x[at]), y[at], w[at])
        return model

    def _boost(self, kind: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        share = np.clip(np.average(y, weights=w) if len(y) else 0.5, 0.01, 0.99)
        self.starts[kind] = float(np.log(share / (1 - share)))
        z = np.full(len(y), self.starts[kind])
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h = w * (y - p), w * p * (1 - p)
            worth = lambda at: float(RATE * g[at].sum() / (h[at].sum() + 1))  # noqa: B023, E731
            top = _split(x, g, h, w, np.ones(len(y), bool))
            if top is None:
                break
            right = x[:, top[0]] > top[1]
            sides, leaves = [], []
            for at in (~right, right):
                split = _split(x, g, h, w, at)
                sides.append(split)
                deep = at & (x[:, split[0]] > split[1]) if split else np.zeros(len(y), bool)
                leaves.append([worth(at & ~deep), worth(deep) if deep.any() else 0.0])
            self.trees[kind].append(Tree(top, sides, leaves))
            z = z + self.trees[kind][-1].score(x)


def _platt(z: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic regression of y on z, whose rows count n times each, by Newton steps that never raise the loss; labels are drawn in a little, so a clean split stays finite."""
    yes, no = n[y == 1].sum(), n[y == 0].sum()
    t = np.where(y == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
    x = np.stack([z, np.ones(len(z))], 1)
    loss = lambda w: float((n * (np.logaddexp(0, x @ w) - t * (x @ w))).sum() + 1e-3 * w[0] ** 2)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(2), x.T @ (n * (p - t)) + 2e-3 * np.array([w[0], 0]))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return (float(w[0]), float(w[1])) if w[0] > 0 else (0.0, -40.0)


def rewritten(kind: Column, s: Column) -> Column:
    """Array of (s, y, form) of a rule's span in other forms: disguised ones, which are still personal data (y 1), and broken ones, which aren't (y 0)."""
    d = digits_of(s)
    form = lambda k, text, y=1.0: F.struct(text.alias("s"), F.lit(y).alias("y"), F.lit(k).alias("form"))
    said = lambda at, dot: F.replace(F.replace(s, F.lit("@"), F.lit(at)), F.lit("."), F.lit(dot))
    local = F.replace(F.substring_index(s, "@", 1), F.lit("."), F.lit("-"))
    spelled = F.concat(local, F.lit(" at "), F.replace(F.substring_index(s, "@", -1), F.lit("."), F.lit(" dot ")))
    email = F.array(form(0, F.replace(s, F.lit("@"), F.lit(" [at] "))), form(1, F.replace(s, F.lit("@"), F.lit("(at)"))), form(2, said("[at]", "[dot]")), form(3, F.replace(s, F.lit("@"), F.lit(" @ "))), form(4, spelled), form(5, F.regexp_replace(F.regexp_replace(s, "[A-Za-z_%+-]", ""), "@", "0 @ 1"), 0.0), form(6, F.lit("2 @ 3.50"), 0.0))
    ip = F.array(form(0, F.replace(s, F.lit("."), F.lit("[.]"))), form(1, F.replace(s, F.lit("."), F.lit("(.)"))), form(2, F.replace(s, F.lit("."), F.lit(" . "))), form(3, F.replace(s, F.lit("."), F.lit("[dot]"))), form(4, F.regexp_replace(F.regexp_replace(s, "[0-9]+$", "700"), r"\.", "[.]"), 0.0), form(5, F.concat_ws(",", F.lit("1"), F.substring(d, 1, 3), F.substring(d, 4, 3), F.lit("000")), 0.0), form(6, F.regexp_replace(F.regexp_replace(s, r"[0-9]+", "400"), r"\.", " . "), 0.0))
    other = F.concat(F.expr("substring(__d, 1, length(__d) - 1)"), ((F.right(F.col("__d"), F.lit(1)).cast("int") + 1) % 10).cast("string"))
    grouped = lambda x, sep: F.regexp_replace(x, "(.{4})(?=.)", f"$1{sep}")
    card = F.array(form(0, grouped(d, ".")), form(1, grouped(d, "_")), form(2, grouped(d, " - ")), form(3, grouped(d, "/")), form(4, grouped(other, "."), 0.0), form(5, grouped(other, " "), 0.0), form(6, other, 0.0), form(7, grouped(other, "_"), 0.0))
    tail = F.right(F.concat(F.lit("0000000000"), d), F.lit(10))
    dashed = lambda sep: F.concat_ws(sep, F.substring(tail, 1, 3), F.substring(tail, 4, 3), F.substring(tail, 7, 4))
    bare = F.regexp_replace(s, r"[+()]", "")
    phone = F.array(form(0, F.concat(F.lit("00"), bare)), form(1, dashed("-")), form(2, dashed(".")), form(3, F.concat(F.lit("("), F.substring(tail, 1, 3), F.lit(") "), F.substring(tail, 4, 3), F.lit("-"), F.substring(tail, 7, 4))), form(4, dashed(" ")), form(5, F.concat(F.lit("("), F.substring(tail, 1, 4), F.lit("/"), F.substring(tail, 5, 4), F.lit(")")), 0.0), form(6, F.concat(F.lit("00"), F.substring(d, 1, 5), F.lit("."), F.substring(d, 1, 1)), 0.0), form(7, F.concat(F.lit("00"), d, d), 0.0))
    return F.when(kind == 0, email).when(kind == 1, ip).when(kind == 2, card).otherwise(phone)


#: The form of each kind that the trees don't see.
UNSEEN = 3
#: Spans of each kind, of names and numbers set aside for examples. They teach beside the corpus' own, so that a kind is judged
#: however few of it a corpus holds; a corpus of some size outweighs them.
KNOWN = {
    "email": ["jane.doe@example.org", "max@example.com", "a_b+c@mail.example.net", "info@example.edu", "x.y.z@sub.example.org", "team-1@example.com"],
    "ip": ["192.0.2.1", "198.51.100.27", "203.0.113.250", "10.0.0.1", "172.16.254.3", "192.168.1.77"],
    "card": ["4111111111111111", "5555555555554444", "378282246310005", "6011111111111117", "30569309025904", "4222222222222"],
    "phone": ["+1 202 555 0143", "+44 20 7946 0958", "+49 30 23125 042", "+1 (415) 555-0199", "+33 1 99 00 12 34", "+61 2 5550 1234"],
}
#: What looks like them and isn't: prices, and too few digits for a telephone.
NEVER = {
    "email": ["2 @ 3.50", "10 @ 1.99", "5 @ 0.75", "12 @ 4.5", "100 @ 2.25", "7 @ 19.95"],
    "phone": ["(1234/5678", "(2020 - 2021", "(12.34.56.78", "+12 34 56 78", "(1999/2000", "(10 / 20 / 30"],
}
#: What stands before and after each of them.
SAID = [(" write to ", " today"), ("contact: ", "."), ("", ""), (" (", ") ")]


def known(spark: SparkSession, table: dict[str, list[str]]) -> DataFrame:
    """Columns doc_id (null), held, kind, s, __d, before, after of the entries of KNOWN or NEVER in every surrounding of SAID; half of the entries are held out."""
    rows = [(j % 2 == 1, KINDS.index(k), s, before[-AROUND:], after) for k, entries in table.items() for j, s in enumerate(entries) for before, after in SAID]
    made = spark.createDataFrame(rows, "held boolean, kind int, s string, before string, after string")
    return made.select(F.lit(None).cast("long").alias("doc_id"), "held", "kind", "s", digits_of(F.col("s")).alias("__d"), "before", "after")


def examples(docs: DataFrame) -> DataFrame:
    """Columns y, held and FEATURES of the candidates of a bounded sample: rewritten spans of the rules, and candidates that no rule accepts in any form."""
    some = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(hashed_share("doc_id", SAMPLED, docs.count()) & F.col("text").rlike("[0-9@]"))
    found = stored(some.select("doc_id", base_spans(F.col("text"), "before", "after").alias("base"), candidates(F.col("text")).alias("loose")), "spans")
    around = [F.col("c.before").alias("before"), F.col("c.after").alias("after")]
    yes = found.select("doc_id", F.explode("base").alias("c")).select("doc_id", F.col("c.kind").alias("kind"), F.col("c.s").alias("s"), digits_of(F.col("c.s")).alias("__d"), *around)
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == 1
    yes = yes.select("doc_id", held.alias("held"), "kind", "s", "__d", "before", "after").union(known(docs.sparkSession, KNOWN))
    yes = yes.select("doc_id", "held", "kind", "before", "after", F.inline(rewritten(F.col("kind"), F.col("s"))))
    # only what a generator would propose as a whole
    proposed = lambda k: reduce(Column.__or__, (F.regexp_extract(F.col("s"), g, 0) == F.col("s") for g in LOOSE[k]))
    yes = yes.filter(F.when(F.col("kind") == 0, proposed("email")).when(F.col("kind") == 1, proposed("ip")).when(F.col("kind") == 2, proposed("card")).otherwise(proposed("phone")))
    no = found.select("doc_id", F.explode(apart(F.col("loose"), F.col("base"))).alias("c"))
    no = no.select("doc_id", held.alias("held"), F.col("c.kind").alias("kind"), *around, F.col("c.s").alias("s"), F.lit(0.0).alias("y"), F.lit(-1).alias("form")).filter(~F.coalesce(accepted(F.col("kind"), plain(F.col("kind"), F.col("s"))), F.lit(False)))
    never = known(docs.sparkSession, NEVER).select("doc_id", "held", "kind", "before", "after", "s", F.lit(0.0).alias("y"), F.lit(-1).alias("form"))
    rows = yes.union(no.select(yes.columns)).union(never).distinct()
    named = [f.alias(n) for f, n in zip(features(F.col("kind"), F.col("s"), F.col("before"), F.col("after")), FEATURES, strict=True)]
    return rows.filter(F.col("held") | (F.col("form") != UNSEEN)).select("y", "held", *named)


def train(docs: DataFrame) -> Chooser:
    """Learns from `examples`; equal ones are counted, so what comes to the driver are their distinct kinds."""
    rows = examples(docs).groupBy("y", "held", *FEATURES).agg(F.count("*").alias("n")).collect()
    rows = sorted(tuple(r) for r in rows)
    x = np.array([r[2:-1] for r in rows], float).reshape(-1, len(FEATURES))
    y, held, n = (np.array([r[k] for r in rows], float) for k in (0, 1, -1))
    return Chooser.fitted(x, y, held == 1, n)


SPAN = "array<struct<kind:int,start:int,end:int,s:string>>"


def _with_spans(docs: DataFrame, model: Chooser | None) -> DataFrame:
    """The documents with columns __base and __added."""
    said = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("__base", base_spans(said))
    if model is None or not any(model.odds):
        return out.withColumn("__added", F.array().cast(SPAN))
    out = out.withColumn("__all", candidates(said))
    out = out.withColumn("__loose", F.when(F.size("__all") > 0, apart(F.col("__all"), F.col("__base"))))

    def judged(c: Column) -> Column:
        made = let(F.array(*features(c["kind"], c["s"], c["before"], c["after"])), lambda f: model.probability_column([F.get(f, F.lit(k)) for k in range(len(FEATURES))]))
        return F.struct(F.round(made, 6).alias("p"), (c["end"] - c["start"]).alias("size"), (-c["start"]).alias("back"), (-c["by"]).alias("order"), c["by"].alias("by"), c.alias("c"))

    out = out.withColumn("__scored", F.when(F.size("__loose") > 0, F.filter(F.transform("__loose", judged), lambda j: j["p"] >= PROBABLE)))
    rank = lambda j: F.struct(j["p"], j["size"], j["back"], j["order"])
    kept = F.transform(likeliest(F.col("__scored"), rank), lambda j: F.struct(*(j["c"][k].alias(k) for k in ("kind", "start", "end", "s"))))
    return out.withColumn("__added", F.coalesce(F.when(F.size("__scored") > 0, kept), F.array().cast(SPAN))).drop("__all", "__loose", "__scored")


def found(docs: DataFrame, model: Chooser | None) -> DataFrame:
    """Columns doc_id, base and added (arrays of kind, start, end, s): one row for each row of `docs` (doc_id, text).

    `added` are candidates apart from all rules' spans whose probability reaches
    PROBABLE; of those that overlap, the likeliest (then the longest, the first, the
    first kind) stays. A null text counts as empty; ids may be null or repeated. Other
    columns are ignored.
    """
    return _with_spans(docs.select("doc_id", "text"), model).select("doc_id", F.col("__base").alias("base"), F.col("__added").alias("added"))


def as_text(all_spans: Column) -> Column:
    """kind:start:end of each span, by kind and then start, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(all_spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def redacted(docs: DataFrame, model: Chooser | None) -> DataFrame:
    """The documents, row by row and with all their columns, with each span in `text` replaced by its kind in brackets; a null text stays null."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    every = F.array_sort(F.transform(F.concat("__base", "__added"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def one(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        again = x["start"] < acc["at"]  # of spans that overlap the first one is named
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], F.array(gap, F.when(again, "").otherwise(F.get(names, x["kind"])))).alias("out"))

    text = F.aggregate(every, begin, one, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return _with_spans(docs, model).withColumn("text", F.when(F.col("text").isNotNull(), text)).select(docs.columns)
