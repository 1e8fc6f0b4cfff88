"""Word hashes tell apart words that sums over letters can't, in the operators that use them."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sigweave.llm import decontaminate, near_dup, quality_rules, words


def thue_morse(n):
    """A word of n letters and its complement: polynomials of their letters modulo a power of two are equal."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def hashes(texts):
    return [h[at[k] : at[k + 1]] for _, h, at in words.hashed_words(pa.array(texts)) for k in range(len(at) - 1)]


@pytest.mark.parametrize("n", [16, 256, 257, 1024, 4096])
def test_complements_differ(n):
    one, two = thue_morse(n)
    a, b = hashes([one, two])
    assert len(a) == len(b) == 1 and a[0] != b[0]


def test_equal_words_have_equal_hashes_and_others_differ():
    pick = random.Random(3)
    said = ["".join(pick.choices("abé\0", k=pick.choice([1, 2, 7, 8, 9, 15, 16, 17, 100, 300]))) for _ in range(3000)]
    said += ["a", "a\0", "a" * 8, "a" * 8 + "\0", "\0", "\0\0"]
    alone = np.concatenate(hashes(said))
    together = np.concatenate(hashes([" ".join(said), ""]))
    assert (alone == together).all()
    assert len(set(alone)) == len(set(said))


def test_operators_tell_such_words_apart(spark):
    one, two = thue_morse(1024)
    schema = "doc_id long, text string"
    out = near_dup.near_duplicates(spark.createDataFrame([(1, one), (2, two), (3, two)], schema)).collect()
    assert {r.doc_id: (r.component_id, r.kept) for r in out} == {1: (1, True), 2: (2, True), 3: (2, False)}
    counted = quality_rules.counted(spark.createDataFrame([(1, f"x {one} y x {two} y"), (2, f"x {one} y x {one} y")], schema)).collect()
    assert {r.doc_id: r.n_repeat_words for r in counted} == {1: 0, 2: 6}
    items = spark.createDataFrame([(7, " ".join([two] * 12))], "item_id long, text string")
    found = decontaminate.leaks(spark.createDataFrame([(1, " ".join([one] * 12)), (2, " ".join([two] * 12))], schema), items)
    assert {r.doc_id for r in found.collect()} == {2}
