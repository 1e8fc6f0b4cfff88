"""Quality rules as a decision list, learned by sequential covering.

Rules reject: each is a conjunction of thresholds over statistics of a text. A rule
is grown on one part of the labelled rows and pruned on another; the rows that it
covers go, and the next one is learned. The list becomes one conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.llm.shared import bounded_batches, hashed_share, stored
from sigweave.llm.words import hashed_words, shingles

#: Labelled rows that learning uses in expectation (all, if there are no more), those of the least hashes of their ids.
LABELLED = 20_000
#: Bounds of the list: rules, conditions of a rule, and cuts that a statistic is tried with.
RULES, CONDITIONS, CUTS = 12, 4, 64
#: A rule must be right on so much of what it covers in the part kept for pruning.
LEAST_PRECISION, LEAST_COVERED = 0.9, 5
#: The statistics that rules compare, as SQL over the counts.
STATISTICS = {
    "words": "n_words",
    "chars_per_word": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "capitals_per_char": "n_capitals / word_chars",
    "digits_per_char": "n_digits / word_chars",
    "repeated_line_share": "n_dup_lines / n_lines",
    "repeated_word_share": "n_repeat_words / n_words",
    "distinct_word_share": "n_distinct_words / n_words",
}
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_digits", "n_distinct_words")
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def counted(docs: DataFrame) -> DataFrame:
    """Columns doc_id and COUNTS (long) of each whole text, and base_failed; a null text counts as empty."""
    bounded_batches(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            rows = np.zeros((len(texts), len(COUNTS)), np.int64)
            for first, h, at in hashed_words(batch.column(1), lower=False):
                for k in range(len(at) - 1):
                    own, text = h[at[k] : at[k + 1]], texts[first + k]
                    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
                    repeated = 0
                    if len(own) > 3:
                        _, which, times = np.unique(shingles(own, 3), return_inverse=True, return_counts=True)
                        twice = np.flatnonzero(times[which] > 1)
                        inside = np.zeros(len(own), bool)
                        for shift in range(3):
                            inside[twice + shift] = True
                        repeated = int(inside.sum())
                    lines = [x for x in text.split(b"\n") if x.strip()]
                    chars = seen.sum() - seen[128:192].sum() - seen[9:14].sum() - seen[32]
                    rows[first + k] = (len(own), chars, seen[_SYMBOLS].sum(), len(lines) - len(set(lines)), repeated, len(lines), seen[65:91].sum(), seen[48:58].sum(), len(np.unique(own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], ["doc_id", *COUNTS])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))
    return out.withColumn("base_failed", F.expr(BASE_FAILED))


@dataclass(frozen=True)
class Condition:
    """A statistic at most, or over, a threshold."""

    name: str
    over: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.cut if self.over else x[self.name] <= self.cut

    def __str__(self) -> str:
        return f"({STATISTICS[self.name]} {'>' if self.over else '<='} {self.cut!r}D)"


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def grown(x: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray) -> Rule:
    """The conjunction that conditions of most information gain make, until it covers no good row."""
    rule, inside = [], weight > 0
    while len(rule) < CONDITIONS and (inside & ~bad).any() and (inside & bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best, most = None, 0.0
        for name, values in x.items():
            cuts = np.unique(np.quantile(values[inside], np.linspace(0, 1, CUTS), method="lower"))
            for cut in cuts[:-1]:
                for over in (True, False):
                    hit = inside & ((values > cut) if over else (values <= cut))
                    p, n = (hit & bad).sum(), (hit & ~bad).sum()
                    gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))) if p else 0.0
                    if gain > most + 1e-9:
                        best, most = Condition(name, over, float(cut)), gain
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def decision_list(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Rules in order; rows are split for growing (two of three) and pruning by their place."""
    n = len(bad)
    prune = np.arange(n) % 3 == 2
    left, rules = np.ones(n, bool), []
    while len(rules) < RULES and (left & bad & ~prune).sum() >= LEAST_COVERED:
        rule = grown(x, bad, (left & ~prune).astype(float))
        # of the rule's beginnings the one with the best balance on the other part; the longer one on ties keeps more good rows
        worth = {}
        for k in range(1, len(rule) + 1):
            hit = covered(rule[:k], x, n) & left & prune
            p, q = (hit & bad).sum(), (hit & ~bad).sum()
            worth[k] = ((p - q) / (p + q) if p + q else -1.0, p, p / max(p + q, 1))
        if not worth:
            break
        k = max(worth, key=lambda k: (worth[k][0], worth[k][1], k))
        if worth[k][2] < LEAST_PRECISION or worth[k][1] < LEAST_COVERED:
            break
        rules.append(rule[:k])
        left &= ~covered(rule[:k], x, n)
    return rules


def as_expression(rules: list[Rule]) -> Column:
    """The list as one conditional expression: false under the first rule that holds, else true."""
    said = F.lit(True)
    for rule in reversed(rules):
        said = F.when(F.expr(" and ".join(map(str, rule))), False).otherwise(said)
    return said


def learned(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """The decision list of the rows that labels call bad (quality 0), among those that the base rules pass; empty without labels of both kinds."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = stored(known, "labelled")
    known = known.filter(hashed_share("doc_id", LABELLED, known.count()))
    rows = counted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")).filter("not base_failed").join(F.broadcast(known), "doc_id")
    rows = rows.select("doc_id", "quality", *(F.expr(e).cast("double").alias(k) for k, e in STATISTICS.items()))
    table = rows.toPandas().sort_values(["doc_id", *STATISTICS])
    bad = table["quality"].to_numpy() == 0
    return decision_list({k: table[k].fillna(0).to_numpy() for k in STATISTICS}, bad) if bad.any() and not bad.all() else []


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns doc_id, the counts, base_failed and kept: one row for each row of `docs` (doc_id, text).

    A null or blank text has no words and fails the base rules, which only texts of 50
    words and more pass; so no share that a rule compares has a denominator of 0.
    Labels that differ count as the worst. Rows that repeat a doc_id are judged one by
    one, those without one too. Other columns are ignored.
    """
    rules = learned(docs, labels)
    out = counted(docs)
    return out.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(F.coalesce(as_expression(rules), F.lit(True))))
