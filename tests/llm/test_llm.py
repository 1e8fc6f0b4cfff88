"""The operators against plain versions, round trips and held-out accuracy, with nulls, ties and very long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigweave.llm import bpe, chat, decontaminate, language_id, line_dedup, linking, lm_scoring, near_dup, pii, quality_model, quality_rules, words

public = pytest.importorskip("public_tokenizers")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, id int, key string, a string"


def plain_words(text, lower=True):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW) if lower else text or "")


def docs_of(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 7, "k", "a") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_hashed_words_do_not_depend_on_chunks():
    texts = ["", None, "A b\tc\n é🙂", " lead", "x" * 50, "one two " * 40, "tail "]
    whole = {}
    usual = words.CHUNK
    for chunk in (usual, 16):
        words.CHUNK = chunk
        found = []
        for _, h, at in words.hashed_words(pa.array(texts)):
            found += [tuple(h[at[k] : at[k + 1]]) for k in range(len(at) - 1)]
        assert [len(f) for f in found] == [len(plain_words(t)) for t in texts]
        whole[chunk] = found
    words.CHUNK = usual
    assert whole[16] == whole[usual]


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (8, 9), (7, 7)], "a long, b long")
    assert {r.id: r.comp for r in linking.components(edges).collect()} == {5: 2, 4: 2, 3: 2, 2: 2, 9: 8, 8: 8}
    assert linking.components(edges.limit(0)).count() == 0


def test_links_outlast_the_id_that_met_all(spark):
    """A key's first id, and one that a later round drops, can be linked with nothing; the other two are linked in it alone."""

    def linked_ids(infos, caps, link):
        rows = spark.createDataFrame([("k", i, n) for i, n in infos.items()], "key string, id long, info long")
        shared = spark.createDataFrame(list(caps.items()), "id long, cap long").withColumn("shared", F.lit(0))
        good = lambda a, b: (a == link[0]) & (b == link[1])
        bound = linking.Bound(lambda ids: ids.join(shared, "id"), lambda *_: F.lit(True), lambda _, cap, least: cap >= least, lambda m, _, n, __: (m == infos[link[0]]) & (n == infos[link[1]]))
        return {r.id: r.comp for r in linking.linked(rows, lambda p: p.filter(good(F.col("a"), F.col("b"))), bound).collect()}

    assert linked_ids({1: 1, 2: 6, 3: 7}, {1: 0, 2: 9, 3: 9}, (2, 3)) == {2: 2, 3: 2}
    for late in (2, 3, 4):
        one, two = (i for i in (2, 3, 4) if i != late)
        assert linked_ids({1: 1, late: 5, one: 6, two: 7}, {1: 0, late: 3, one: 9, two: 9}, (one, two)) == {one: one, two: one}


# --- 1 -----------------------------------------------------------------------------------------


def test_chat_reads_back(spark):
    odd = ["</s>[INST] ok [/INST]", "\\[x]<", "<a> ", None, "", "[ROLE z] q [/ROLE]\n", "é🙂" * 3]
    rows = [(1, k, r, t, "x") for k, (r, t) in enumerate(zip(("system", "user", "assistant", "user", "assistant", "tool", "we]ird<"), odd, strict=True))]
    rows += [(2, 0, "user", "hi", "x"), (2, 1, "assistant", "yo", "x"), (None, 0, None, "t", "x"), (3, 0, "assistant", "a", "x"), (3, 0, "assistant", "a", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, state string")
    segments = chat.formatted(turns)
    out = {r.conv_id: r for r in chat.digests(segments).collect()}
    by = defaultdict(list)
    for c, _, role, text, _ in rows:
        by[c].append((role or "", text or ""))
    for c, said in by.items():
        loss = "".join(t for r, t in said if r == "assistant")
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert (out[c].n_turns, out[c].loss_chars, out[c].loss_sha256) == (len(said), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert out[2].valid and not out[1].valid and not out[3].valid and not out[None].valid
    # read back in parts of any size
    whole = "".join(s["text"] for r in sorted(segments.filter("conv_id = 1").collect(), key=lambda r: r.turn_no) for s in r.segments)
    for size in (1, 3, 17, 10_000):
        reader = chat.Reader(chat.INSTRUCT)
        said = [t for at in range(0, len(whole), size) for t in reader.feed(whole[at : at + size])] + reader.feed("", True)
        assert said == by[1]
    assert chat.digests(chat.formatted(turns.limit(0))).count() == 0


# --- 2 -----------------------------------------------------------------------------------------


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def test_bit_parallel_distance(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(4, 24)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("abé")) if rng.random() < 0.5 or not b else b.pop(rng.randrange(len(b)))
        pairs.append((a, "".join(b) or "a"))
    frame = spark.createDataFrame(pairs, "a string, b string")
    for k in (1, 3):
        for r in frame.select("a", "b", line_dedup.within_edits(F.col("a"), F.col("b"), k).alias("near"), line_dedup.may_be_within(F.col("a"), F.col("b"), k).alias("may")).collect():
            assert r.near == (edit_distance(r.a, r.b) <= k)
            assert r.may or not r.near


def test_line_dedup(spark):
    rng = random.Random(2)
    line = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n)).replace(" ", "x", 1)
    base = [line(40) for _ in range(12)]
    rows = []
    for i in range(30):
        own = [line(35) for _ in range(2)] + [rng.choice(base) for _ in range(3)] + ["short", "", "short"]
        own = [x[:10] + "Z" + x[11:] if rng.random() < 0.3 and len(x) > 30 else x for x in own]
        rows.append((i, "\n".join(own)))
    rows += [(50, None), (51, ""), (52, base[0] + "\n" + base[0]), (53, "y" * 30_000)]
    frame = docs_of(spark, rows)
    out = {r.doc_id: r for r in line_dedup.dedup_lines(frame).collect()}
    lines = [(i, p, x) for i, t in rows if t is not None for p, x in enumerate(t.split("\n")) if plain_words(x)]
    texts = list(dict.fromkeys(x for _, _, x in lines))
    root = {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, x in enumerate(texts):
        for y in texts[k + 1 :]:
            if abs(len(x) - len(y)) <= 2 and line_dedup.LEAST_CHARS <= min(len(x), len(y)) and len(x) < 100 and edit_distance(x, y) <= 2:
                root[find(y)] = find(x)
    first = {}
    for i, p, x in lines:
        first[find(x)] = min(first.get(find(x), (i, p)), (i, p))
    gone = {(i, p) for i, p, x in lines if first[find(x)] != (i, p)}
    for i, t in rows:
        want = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)
        assert out[i].text == want and out[i].n_removed == sum(g[0] == i for g in gone)
    assert out[0].key == "k" and gone and (0, 7) in gone
    clash = line_dedup.dedup_lines(frame.withColumns({"N_lines": F.lit(-1), "n_removed": F.lit(-2), "__removed": F.lit(-3)}).limit(3))
    assert clash.columns[-5:] == ["N_lines", "n_removed", "__removed", "n_lines_", "n_removed_"]
    assert all((r["N_lines"], r["n_removed"], r["__removed"]) == (-1, -2, -3) and r["n_lines_"] == 8 for r in clash.collect())
    again = line_dedup.dedup_lines(docs_of(spark, [(None, "a b"), (None, "a b"), (1, "c d"), (1, "c d"), (2, "c d")])).collect()
    assert sorted((str(r.doc_id), r.text) for r in again) == [("1", "c d"), ("1", "c d"), ("2", ""), ("None", "a b"), ("None", "a b")]
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0


def test_near_copies_that_differ_in_many_places_meet_seldom(spark):
    """What rules lines and pairs out before they are compared never rules out two lines within two edits, and leaves few pairs of a large group."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 7)))
    base = [word() for _ in range(60)]
    copies = [" ".join(word() if rng.random() < 0.05 else w for w in base) for _ in range(120)]
    for x in copies[:40]:  # and some within two edits of these
        at, other = rng.sample(range(len(x)), 2)
        copies.append(rng.choice([x[:at] + "z" + x[at:], x[:at] + x[at + 1 :], x[:at] + "🙂" + x[at + 1 :]]))
        copies[-1] = copies[-1][:other] + "y" + copies[-1][other + 1 :]
    copies = sorted(set(copies))
    lines = spark.createDataFrame(list(enumerate(copies)), "id long, line string")
    of = F.when(~F.col("line").rlike(line_dedup.ASTRAL), line_dedup.sketch(F.col("line")))
    seen = line_dedup.least_edits(lines).withColumn("sketch", of).cache()
    left = {r.id for r in seen.filter(F.col("cap") <= 2).collect()}
    met = seen.alias("x").crossJoin(seen.alias("y")).filter("x.id < y.id").filter(line_dedup.sketches_agree(F.col("x.sketch"), F.col("y.sketch"), 2))
    may = {(r.a, r.b) for r in met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).collect()}
    linked = 0
    for a, x in enumerate(copies):
        for b in range(a + 1, len(copies)):
            if abs(len(x) - len(copies[b])) <= 2 and edit_distance(x[:60], copies[b][:60]) <= 4 and edit_distance(x, copies[b]) <= 2:
                linked += 1
                assert {a, b} <= left and (a, b) in may
    plain = [i for i, x in enumerate(copies) if "🙂" not in x]
    assert linked >= 30 and len(left) < len(copies)
    assert sum(a in plain and b in plain for a, b in may) < 0.1 * len(plain) ** 2 / 2


# --- 3 -----------------------------------------------------------------------------------------


def test_lm_base_is_exact_and_windows_agree(spark, docs):
    path = public.path("byte_bpe_50k.tiktoken")
    some = docs.filter("doc_id < 60").select("doc_id", "text").union(spark.createDataFrame([(900, None), (901, "    x"), (902, "the " * 3000)], "doc_id long, text string"))
    train = some.filter("doc_id % 5 != 1")
    trained, counts = lm_scoring.train(train, path)
    out = {r.doc_id: r for r in lm_scoring.scored(some, trained, counts, path).collect()}
    said = {r.doc_id: plain_words(r.text) + [""] for r in some.collect()}
    c = Counter(w for i, ws in said.items() if i % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in said.items():
        want = sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (out[i].n_tokens, out[i].n_known, out[i].train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(out[i].base_score - want) < 1e-6 * abs(want) and out[i].score < 0
    # a text's price doesn't depend on what stands beside it in the batch
    texts = [[w.encode() for w in said[i][:-1]] for i in (3, 4, 900)]
    alone = [lm_scoring.batch_prices(trained, [t], path)[0][1].sum() for t in texts]
    beside = [p[1].sum() for p in lm_scoring.batch_prices(trained, texts, path)]
    assert np.allclose(alone, beside, rtol=1e-5)


def test_lm_scores_do_not_depend_on_where_words_are_priced(spark, docs, monkeypatch):
    path = public.path("byte_bpe_50k.tiktoken")
    train = docs.filter("doc_id < 40").select("doc_id", "text")
    some = train.union(spark.createDataFrame([(900, None), (901, "zqxzqx the"), (902, "q" * 5000), (None, "x")], "doc_id long, text string"))
    out = []
    for one_in in (1_000_000, 100, 1):
        monkeypatch.setattr(lm_scoring, "FREQUENT_ONE_IN", one_in)
        trained, counts = lm_scoring.train(train, path)
        out.append((trained, {r.doc_id: r for r in lm_scoring.scored(some, trained, counts, path).collect()}))
    assert len(out[0][0].frequent) == counts.count() > 10 * len(out[1][0].frequent) and not out[2][0].frequent
    for trained, rows in out[1:]:
        assert abs(trained.weight - out[0][0].weight) < 1e-4 and len(rows) == len(out[0][1])
        for i, r in out[0][1].items():
            assert rows[i].n_known == r.n_known and abs(rows[i].base_score - r.base_score) < 1e-6 * abs(r.base_score)
            assert abs(rows[i].score - r.score) < 1e-3 * abs(r.score)


def test_lm_without_training_rows(spark):
    path = public.path("byte_bpe_50k.tiktoken")
    some = spark.createDataFrame([(1, "a b", 5, "x"), (1, "a b", 5, "x"), (2, None, 5, "x")], "doc_id long, text string, c long, word string")
    trained, counts = lm_scoring.train(some.limit(0), path)
    out = {r.doc_id: r for r in lm_scoring.scored(some, trained, counts, path).collect()}
    assert (out[1].n_tokens, out[1].n_known, out[1].train_tokens) == (6, 0, 0) and out[2].n_tokens == 1 and out[1].score < 0
    assert lm_scoring.scored(some.limit(0), trained, counts, path).count() == 0


def test_lm_learns_from_every_text(spark, docs):
    """Attention makes the texts that it learns from likelier, and windows come from all of them."""
    path = public.path("byte_bpe_50k.tiktoken")
    words = [lm_scoring.words_of(r.text) for r in docs.filter("doc_id < 60").collect()]
    end = len(lm_scoring.encoding(path)._mergeable_ranks)
    for w in words:
        whole = np.concatenate([[end], lm_scoring.ids_of(w, path)[0], [end]])
        rows = lm_scoring.windows(w, path, end)
        assert len(rows) >= (len(w) + 1) // lm_scoring.SPACING and rows.shape[1] == lm_scoring.CONTEXT + lm_scoring.STRIDE + 1
        for row in rows:
            real = row[row >= 0].tolist()
            assert any(whole[k : k + len(real)].tolist() == real for k in range(len(whole) - len(real) + 1))
    counts = lm_scoring.with_ids(lm_scoring.word_counts(docs), path).cache()
    model = lm_scoring.counted_model(counts, path)
    ids = np.concatenate([np.concatenate([[end], lm_scoring.ids_of(w, path)[0], [end]]) for w in words])
    texts = np.repeat(np.arange(len(words)), [len(lm_scoring.ids_of(w, path)[0]) + 2 for w in words])
    before = model.log_p(ids, texts)[0].sum()
    begun = model.to_group.copy()
    lm_scoring.fit_on_all(model, docs, path)
    assert not np.allclose(begun, model.to_group)
    # texts that it doesn't learn from become likelier
    more = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id >= 1000 and doc_id < 4000").collect()
    lm_scoring.fit(model, np.concatenate([lm_scoring.windows(lm_scoring.words_of(r.text), path, end) for r in more]))
    assert model.log_p(ids, texts)[0].sum() > 0.97 * before


def test_lm_learns_from_every_id():
    """Each id of a text, and its end, is the next one in just one window, after those before it."""
    path = public.path("byte_bpe_50k.tiktoken")
    end = len(lm_scoring.encoding(path)._mergeable_ranks)
    for n in (0, 1, 15, 16, 17, 400):
        words = [b"word%d" % k for k in range(n)]
        whole = np.concatenate([[end], lm_scoring.ids_of(words, path)[0], [end]])
        rows = lm_scoring.windows(words, path, end)
        new = rows[:, lm_scoring.CONTEXT + 1 :].ravel()
        assert new[new >= 0].tolist() == whole[1:].tolist()
        for k, row in enumerate(rows):
            before = whole[max(0, k * lm_scoring.STRIDE - lm_scoring.CONTEXT) : k * lm_scoring.STRIDE + 1]
            assert row[: lm_scoring.CONTEXT + 1].tolist() == [-1] * (lm_scoring.CONTEXT + 1 - len(before)) + before.tolist()


def test_lm_looks_words_up_once_a_batch(monkeypatch):
    """The words and ids of texts are those of each text and each word alone, and a word is looked up once however often it occurs, wherever its text is priced."""
    path = public.path("byte_bpe_50k.tiktoken")
    texts = ["", None, "  A b ", "\u3000x \u3000 y\u3000 \u3000\u3000 z", "A\tB\nc\x0b\x0c\rd\x1ce\x85f \xa0 g", "don't 'S 123 x's b", "  \t"] + ["the same unheardword%d words here" % (k % 7) for k in range(200)]
    said = lm_scoring.Said.of(pa.array(texts, pa.string()))
    known, (ids, sizes) = said.spelt(), said.ids(path)
    alone = lm_scoring.encoding(path).encode_ordinary
    plain = [lm_scoring.words_of(x) for x in texts]
    assert [[known[i] for i in said.index[a:b]] for a, b in zip(said.offsets, said.offsets[1:], strict=False)] == plain
    each = [alone(" " + w.decode()) for words in plain for w in words]
    assert ids.tolist() == [i for x in each for i in x] and sizes.tolist() == [len(x) for x in each]
    model, asked = random_model(50258, np.arange(50258) % 2 == 0), []
    monkeypatch.setattr(lm_scoring, "PRICED", 100)
    monkeypatch.setattr(lm_scoring.WordIds, "of", lambda self, words, of=lm_scoring.WordIds.of: asked.extend(words) or of(self, words))
    trained = lm_scoring.Trained(model, 0.5, {b"the": 5}, 100, 10)
    two = lm_scoring.prices(trained, said, path).two
    assert len(asked) == len(set(asked)) < 40
    assert np.allclose(two, np.concatenate([lm_scoring.batch_prices(trained, [words], path)[0][1] for words in plain]), atol=1e-4)


def test_lm_steps_follow_the_slope():
    """The gradients of runs of windows, across texts' borders, are those of the ids' prices."""
    rng = np.random.default_rng(2)
    model = random_model(4000, np.arange(4000) % 2 == 0)
    model.embed *= 0.3
    texts = [np.concatenate([[3999], rng.integers(0, 3999, n), [3999]]) for n in (3, 100, 40, 0, 30)]
    rows = np.concatenate([lm_scoring.cut(x) for x in texts])
    rows = np.concatenate([rows, np.full((-len(rows) % lm_scoring.RUN, rows.shape[1]), -1)]).reshape(-1, lm_scoring.RUN, rows.shape[1])
    grads = lm_scoring.gradients(model, rows)
    size = sum(len(x) - 1 for x in texts)
    ids, owner = np.concatenate(texts), np.repeat(np.arange(5), [len(x) for x in texts])
    for name in lm_scoring.LEARNED:
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        was, cost = getattr(model, name)[at], []
        for step in (0.01, -0.01):
            getattr(model, name)[at] = was + step
            cost.append(-model.log_p(ids, owner)[0].sum(dtype=float) / size)
        getattr(model, name)[at] = was
        assert abs((cost[0] - cost[1]) / 0.02 - grads[name][at]) < 0.03 * abs(grads[name][at]), name


def test_lm_classes_are_ranked_by_all_counted_words():
    of = np.arange(4000, 0, -1).astype(float)
    starts = np.arange(4000) % 2 == 0
    classes = lm_scoring.classes_of(of, starts)
    limit = lm_scoring.STARTS * lm_scoring.MEMBERS
    assert classes[-1] == limit - 1 and (classes[:-1][starts[:-1]] < limit - 1).all() and (classes[:-1][~starts[:-1]] >= limit).all()
    assert classes[0] == 0 and classes[2] == 1 and classes[1] == limit and len({*classes[:900:2]}) == 450


def random_model(n_ids, starts):
    rng = np.random.default_rng(0)
    k, w, g, m = lm_scoring.CLASSES, lm_scoring.WIDTH, lm_scoring.GROUPS, lm_scoring.MEMBERS
    make = lambda *s: 0.5 * rng.normal(size=s).astype(np.float32)
    first = lm_scoring.STARTS * m
    classes = np.where(starts, np.arange(n_ids) // 2 % (first - 1), first + np.arange(n_ids) // 2 % (k - first)).astype(np.int32)
    classes[-1] = lm_scoring.STARTS * m - 1
    of = rng.random(n_ids) + 0.1
    share = np.log(of / np.bincount(classes, of, k)[classes]).astype(np.float32)
    return lm_scoring.Model(classes, share, make(k, g), make(k, g, m), make(k, w), make(w, w), make(w, w), make(w, w), make(lm_scoring.CONTEXT + lm_scoring.STRIDE), make(w, g), make(g, w, m))


def test_attention_sees_no_later_ids():
    n_ids = 4000
    model = random_model(n_ids, np.arange(n_ids) % 2 == 0)
    rng = np.random.default_rng(1)
    ids = rng.integers(0, n_ids, 300)
    texts = np.zeros(300, np.int64)
    one, ends = model.log_p(ids, texts)
    changed = ids.copy()
    changed[200:] = rng.integers(0, n_ids, 100)
    again, ends_again = model.log_p(changed, texts)
    assert np.allclose(one[:200], again[:200], atol=1e-5) and np.allclose(ends[:199], ends_again[:199], atol=1e-5)
    # each id is priced once and properly: the next id's probabilities sum to one, and those of ids that begin a word to what `ends` says
    rows = np.stack([np.append(ids[:20], x) for x in range(n_ids)])
    p, ends = model.log_p(rows.ravel(), np.repeat(np.arange(n_ids), 21))
    total = np.exp(p.reshape(n_ids, 21)[:, -1].astype(float))
    starts = model.classes < lm_scoring.STARTS * lm_scoring.MEMBERS
    assert abs(total.sum() - 1) < 1e-3 and abs(total[starts].sum() - np.exp(ends.reshape(n_ids, 21)[0, 19])) < 1e-3


def test_word_prices_are_a_distribution(spark):
    """A word's price is its ids', given that a word begins, times that the next one begins behind it: with the test above, prices sum to one over all words and the end."""
    path = public.path("byte_bpe_50k.tiktoken")
    train = spark.createDataFrame([(i, "ab ba a b aab " * 20) for i in range(8)], "doc_id long, text string")
    trained, _ = lm_scoring.train(train, path)
    model, end = trained.model, len(trained.model.classes) - 1
    words = [b"ab", b"unseenword", b"a"]
    ids, sizes = lm_scoring.ids_of(words, path)
    p, ends = model.log_p(np.concatenate([[end], ids, [end]]), np.zeros(len(ids) + 2, int))
    one, two = lm_scoring.batch_prices(trained, [words], path)[0]
    at = np.concatenate([[0], np.cumsum(sizes)])
    want = [p[at[k] + 1 : at[k + 1] + 1].sum() - ends[at[k]] + ends[at[k + 1]] for k in range(3)] + [p[-1] - ends[at[3]]]
    assert np.allclose(two, want, atol=1e-3) and one[1] == -np.inf
    said = [b"ab", b"ba", b"a", b"b", b"aab"]
    prices = [lm_scoring.batch_prices(trained, [[*words, w]], path)[0] for w in said]
    last = lm_scoring.batch_prices(trained, [words], path)[0]
    for k, least in ((0, 1 - 1e-9), (1, 0.5)):
        total = sum(np.exp(x[k][3]) for x in prices) + np.exp(last[k][3])
        assert least < total <= 1 + 1e-4


# --- 4 -----------------------------------------------------------------------------------------


def test_leaks(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (6, 20, 40, 15, 3)]
    filler = lambda: [word() for _ in range(30)]
    changed = list(items[2])
    for k in (4, 11, 19, 30):
        changed[k] = "changed"
    rows = [(1, filler() + items[1] + filler()), (2, filler() + changed + filler()), (3, filler()), (4, filler() + items[0]), (5, items[3][:12]), (6, filler() + items[4] + items[1][:8]), (7, [])]
    frame = docs_of(spark, [(i, " ".join(w).upper()) for i, w in rows] + [(8, None), (None, " ".join(items[1])), (1, " ".join(rows[0][1]))])
    bench = spark.createDataFrame([(k, " ".join(w), 1) for k, w in enumerate(items)] + [(9, None, 1), (None, "a", 1)], "item_id long, text string, place int")
    out = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(frame, bench).collect()}
    assert set(out) == {(1, 1), (2, 2), (4, 0), (5, 3)}
    assert out[2, 2].n_matched == 36 and out[2, 2].start == 30 and out[2, 2].span == 40
    assert sorted(str(r.doc_id) for r in decontaminate.drop_leaks(frame, bench).collect()) == ["3", "6", "7", "8", "None"]
    assert decontaminate.leaks(frame.limit(0), bench).count() == 0 and decontaminate.leaks(frame, bench.limit(0)).count() == 0
    # short items: one word of six replaced, a very short one alone and among others
    changed = [*items[0][:2], "other", *items[0][3:]]
    short = docs_of(spark, [(1, " ".join(filler() + changed + filler())), (2, " ".join([*items[0][:2], "x", "y", *items[0][4:]])), (3, " ".join(items[4])), (4, " ".join([*items[4], "x"]))])
    assert {(r.doc_id, r.item_id, r.n_matched) for r in decontaminate.leaks(short, bench).collect()} == {(1, 0, 5), (3, 4, 3)}


def test_leaks_against_all_diagonals(spark):
    """Every diagonal of every document and item, without seeds: what isn't found is rare, and nothing else is."""
    rng = random.Random(14)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("abcdefghijklmnop")
    items = {k: [word() for _ in range(rng.randint(8, 45))] for k in range(40)}
    rows = {}
    for i in range(240):
        own = [word() for _ in range(rng.randint(0, 40))]
        if i % 4:
            item = items[rng.randrange(40)]
            at = rng.randrange(max(1, len(item) - 14))
            passage = [word() if rng.random() < 0.04 * (i % 4) else w for w in item[at:]]
            own[len(own) // 2 : len(own) // 2] = passage
        rows[i] = own
    want = set()
    for i, own in rows.items():
        for k, item in items.items():
            for shift in range(-len(item) + 1, len(own)):
                pairs = [(own[j + shift], item[j]) for j in range(len(item)) if 0 <= j + shift < len(own)]
                equal = np.array([a == b for a, b in pairs])
                whole = len(item) < decontaminate.SPAN
                n = int(equal.sum()) if whole and len(pairs) == len(item) else 0 if whole else decontaminate.overlap(equal)[0]
                if n >= min(decontaminate.ENOUGH_WORDS, -(-decontaminate.ENOUGH_PERCENT * len(item) // 100)):
                    want.add((i, k))
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, bench).collect()}
    print("leaks", len(want), len(want - got))
    assert got <= want and len(want) > 100 and len(want - got) <= 0.02 * len(want)


# --- 5 -----------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.Bpe(path)
    rng = random.Random(1)
    parts = ["a", "the", "ing", " ", "  ", "\n", "\t", "é", "日本", "🙂", "12", "!!", "'s", "'ll", "<|endoftext|>", "<|endof", " ", "Zz", "aaaa", "----"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(800)] + ["a" * 5000 + " " * 300 + "=-" * 900 + "xyz " * 40_000]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids
        assert own.decode(np.array(ids, "<u4")) == library.decode(ids, skip_special_tokens=False)
    one_piece = "th" * 100_000 + "\n" * 70_000
    assert own.encode(one_piece).tolist() == library.encode(one_piece, add_special_tokens=False).ids
    cut = np.array(library.encode("日本🙂", add_special_tokens=False).ids[:-1], "<u4")
    assert own.decode(cut) == library.decode(cut.tolist(), skip_special_tokens=False)
    frame = docs_of(spark, [(1, texts[0]), (2, None), (None, "x"), (1, texts[0])])
    out = bpe.encoded(frame, path)
    assert bpe.encoded(frame.limit(0), path, decode=True).count() == 0
    assert sorted((r.doc_id or 0, r.decoded) for r in bpe.decoded(out, path).collect()) == sorted([(1, texts[0]), (2, ""), (0, "x"), (1, texts[0])])


def test_short_pieces_make_no_states():
    """New pieces within the lookahead give the ids that the states give, and leave no state behind."""
    machine = bpe.Bpe(public.path("byte_bpe_50k.json")).pieces.transducer
    rng = random.Random(4)
    pieces = ["".join(rng.choice(["th", "e", "on", "ing", "é", "日", "🙂", "x", "1"]) for _ in range(rng.randint(1, 12))).encode() for _ in range(3000)]
    found = [machine.encode(p) for p in pieces]
    assert not machine.states and machine.lookahead > bpe.SHORT
    assert found == [b"".join(machine.stream(iter((p,)))) for p in pieces] and machine.states


def test_sufficient_lookahead_suffices():
    """In small random vocabularies no text behind the lookahead changes a token, and some text just within it does in one of them."""
    rng = random.Random(9)
    near = 0
    for _ in range(40):
        ids = {bytes([c]): k for k, c in enumerate(b"abc")}
        merges = []
        while len(merges) < 12:
            a, b = rng.choice(list(ids)), rng.choice(list(ids))
            if a + b not in ids and len(a + b) <= 6:
                merges.append((a, b))
                ids[a + b] = len(ids)
        machine = bpe.Transducer(merges, ids)

        def plain(text):
            parts = [bytes([c]) for c in text]
            while True:
                best = min(((merges.index(p), k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in merges), default=None)
                if best is None:
                    return parts
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

        def ends(parts, limit):
            at, out = 0, []
            for p in parts:
                at += len(p)
                if at <= limit:
                    out.append(at)
            return out

        for _ in range(60):
            text = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 24)))
            other = bytes(rng.choice(b"abc") for _ in range(12))
            assert machine.encode(text) == b"".join(ids[p].to_bytes(4, "little") for p in plain(text))
            firm = len(text) - machine.lookahead
            assert ends(plain(text), firm) == ends(plain(text + other), firm)
            near += ends(plain(text), len(text) - 2) != ends(plain(text + other), len(text) - 2)
    assert near


def test_bpe_forgets_without_harm():
    path = public.path("byte_bpe_50k.json")
    own, fresh = bpe.Bpe(path), bpe.Bpe(path)
    kept = bpe.KEPT_STATES, bpe.KEPT_PIECES, bpe.KEPT_PAIRS
    bpe.KEPT_STATES, bpe.KEPT_PIECES, bpe.KEPT_PAIRS = 20, 10, 10
    text = " ".join("".join(random.Random(k).choice("thinger") for _ in range(9)) for k in range(300))
    small = own.encode(text).tolist()
    bpe.KEPT_STATES, bpe.KEPT_PIECES, bpe.KEPT_PAIRS = kept
    assert small == fresh.encode(text).tolist()


# --- 6 -----------------------------------------------------------------------------------------


def test_quality_counts_and_rules(spark):
    odd = [(1, None), (2, ""), (3, " \n\t\n"), (4, "a a a a\na b\na b\n"), (5, "#x $ é🙂\n#x $ é🙂"), (6, "w" * 50_000)]
    frame = docs_of(spark, odd)
    for r, (_, t) in zip(sorted(quality_rules.counted(frame).collect(), key=lambda r: r.doc_id), odd, strict=True):
        w = plain_words(t, False)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if plain_words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside))
    again = spark.createDataFrame([(1, "a b", 5, True), (1, "a b", 5, True), (None, "c", 5, True)], "doc_id int, text string, n_words int, kept boolean")
    none = spark.createDataFrame([], "doc_id int, quality int")
    assert sorted((str(r.doc_id), r.n_words, r.kept) for r in quality_rules.judged(again, none).collect()) == [("1", 2, False), ("1", 2, False), ("None", 1, False)]
    assert quality_rules.judged(again.limit(0), none).count() == 0
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality_rules.judged(docs, labels).join(labels, "doc_id").filter("not base_failed")
    assert out.filter("kept = (quality = 1)").count() >= 0.95 * out.count()
    assert quality_rules.judged(frame, labels.limit(0)).filter("kept = base_failed").count() == 0


def test_covering_finds_a_conjunction():
    rng = np.random.default_rng(3)
    x = {"a": rng.random(900), "b": rng.random(900)}
    bad = (x["a"] > 0.6) & (x["b"] <= 0.4)
    rules = quality_rules.decision_list(x, bad)
    hit = np.zeros(900, bool)
    for rule in rules:
        hit |= quality_rules.covered(rule, x, 900)
    assert (hit == bad).mean() > 0.97


# --- 7 -----------------------------------------------------------------------------------------

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, s):
    digits = [int(c) for c in s if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum((2 * d - 9 if d > 4 else 2 * d) if k % 2 else d for k, d in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(t):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in RULES.items() for m in re.finditer(p, t or "") if passes(k, m.group()))


def test_pii_spans(spark, docs):
    long = "1" * 40_000 + " " + "1 " * 9000 + "a@b" + ".c" * 9000 + "x" * 50_000
    odd = [(-1, None), (-2, ""), (-3, "a@b.c_x@y.z +1 (234) 567-8901 é🙂 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4"), (-4, long), (-5, "..@-.- x@y.z@w.v 4111-1111-1111-1111 4111 1111 1111 1112")]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    model = pii.train(docs)
    out = pii.found(every, model)
    rows = {r.doc_id: r for r in out.select("doc_id", pii.as_text(F.col("base")).alias("base"), "added").collect()}
    for r in every.collect():
        assert rows[r.doc_id].base == plain_spans(r.text)
    assert all(a.end > a.start for r in rows.values() for a in r.added)
    text = {r.doc_id: r.text for r in pii.redacted(every, model).collect()}
    assert text[-1] is None and "[EMAIL]" in text[-3] and "y.z" not in text[-3]
    assert pii.found(every.limit(0), None).count() == 0


def test_pii_adds_disguised_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    model = pii.train(docs)
    assert all(model.odds)
    yes = {"email": ["jane.doe [at] example.org", "joe(at)site.com", "max [at] mail[dot]net"], "phone": ["555-123-4567", "0049 30 1234567", "(555) 123-4567"], "ip": ["10[.]0[.]0[.]1", "192[dot]168[dot]7[dot]9"], "card": ["4111.1111.1111.1111", "4111_1111_1111_1111"]}
    no = ["on 2020-2021 and 1,234,567 in all", "a score of 3.50 at 7", "chapter 4.2.1 of 1200", "400[.]1[.]2[.]900", "4111.1111.1111.1112 items", "ids 12 13 14 15 16 17 18 19 20", "meet at noon dot", None, ""]
    rows = [(k, f"and then {t} came") for k, (_, t) in enumerate((kind, t) for kind, ts in yes.items() for t in ts)]
    frame = spark.createDataFrame(rows + [(100 + k, t) for k, t in enumerate(no)] + [(None, "by joe(at)site.com here"), (None, "by joe(at)site.com here")], "doc_id long, text string")
    out = defaultdict(list)
    for r in pii.found(frame, model).collect():
        out[r.doc_id] += [(pii.KINDS[a.kind], a.s) for a in r.added] + [("base", b.s) for b in r.base]
    wanted = [(kind, t) for kind, ts in yes.items() for t in ts]
    hit = [w in out[k] for k, w in enumerate(wanted)]
    print("pii", [w for w, h in zip(wanted, hit, strict=True) if not h], {k: v for k, v in out.items() if k and k >= 100 and v})
    assert sum(hit) >= len(hit) - 1 and len(out[None]) == 2
    assert not any(out[100 + k] for k in range(len(no)))
    # a row without id keeps its text, and columns of the operator's own names are the caller's
    clash = frame.withColumns({"base": F.lit(1), "added": F.lit(2), "spans": F.lit(3)})
    again = pii.redacted(clash, model)
    assert again.columns == clash.columns and {r.text for r in again.filter("doc_id is null").collect()} == {"by [EMAIL] here"}
    assert again.filter("base = 1 and added = 2").count() == frame.count()
    # calibrated: of held-out examples, those from the threshold on are nearly all right, and most of the right ones reach it
    table = pii.examples(docs).filter("held").toPandas()
    p, y = model.probability(table[list(pii.FEATURES)].to_numpy(float)), table["y"].to_numpy()
    taken = p >= pii.PROBABLE
    print("pii held-out", y[taken].mean(), taken[y == 1].mean(), len(y))
    assert y[taken].mean() >= 0.95 and taken[y == 1].mean() >= 0.8
    # without a corpus the known examples alone teach, so that every kind is judged
    bare = pii.train(docs.limit(0))
    assert all(bare.odds)
    few = {r.doc_id: {a.s for a in r.added} for r in pii.found(frame.filter("doc_id is not null"), bare).collect()}
    assert sum(t in few[k] for k, (_, t) in enumerate(wanted)) >= len(wanted) - 2


def test_spans_of_very_many_matches(spark):
    text = "a1 " * 700 + "é22🙂3"
    got = spark.createDataFrame([(text,), ("",), ("x",)], "t string").select(pii.spans(F.col("t"), "[0-9]+").alias("s")).collect()
    assert [(x.start, x.end, x.s) for x in got[0].s] == [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", text)] and not got[1].s and not got[2].s


def test_overlaps_by_halving(spark):
    """What stays equals a comparison of all pairs, for lists whose spans ascend within each kind or generator."""
    rng = random.Random(11)

    def ascending(n, longest):
        at, out = 0, []
        for _ in range(n):
            start = at + rng.randint(0, 9)
            at = start + rng.randint(1, longest)
            out.append((start, at))
        return out

    rows = []
    for k in range(40):
        base = [(kind, s, e) for kind in range(4) for s, e in ascending(rng.randint(0, 6), 9)]
        loose = [(pii.GENERATORS[by][0], s, e, by, rng.choice([0.9, 0.95, 1.0])) for by in range(len(pii.GENERATORS)) for s, e in ascending(rng.randint(0, 12), 30 if by == 0 else 6)]
        rows.append((k, base, loose))
    frame = spark.createDataFrame(rows, "k int, base array<struct<kind:int,start:int,end:int>>, loose array<struct<kind:int,start:int,end:int,by:int,p:double>>")
    scored = F.transform("loose", lambda x: F.struct(x["p"].alias("p"), x["by"].alias("by"), x.alias("c")))
    rank = lambda j: F.struct(j["p"], (-j["c"]["start"]).alias("back"), (-j["by"]).alias("order"))
    got = frame.select("k", pii.apart(F.col("loose"), F.col("base")).alias("apart"), pii.likeliest(scored, rank).alias("best")).collect()
    cross = lambda a, b: a[1] < b[2] and b[1] < a[2]
    order = lambda x: (x[4], -x[1], -x[3])
    for r in got:
        _, base, loose = rows[r.k]
        assert [tuple(x) for x in r.apart] == [x for x in loose if not any(cross(x, b) for b in base)]
        assert [tuple(x.c) for x in r.best] == [x for x in loose if not any(cross(x, o) and order(o) > order(x) for o in loose)]


def test_examples_count_as_often_as_they_are():
    rng = np.random.default_rng(3)
    x = np.round(rng.random((200, len(pii.FEATURES))), 1)
    x[:, -1] = 0
    y, held, n = (x[:, 0] > 0.4).astype(float), np.arange(200) % 2 == 1, rng.integers(1, 5, 200)
    often = [np.repeat(v, n, axis=0) for v in (x, y, held)]
    np.testing.assert_allclose(pii.Chooser.fitted(x, y, held, n.astype(float)).probability(x), pii.Chooser.fitted(*often).probability(x), rtol=1e-6, atol=1e-9)


def test_text_of_very_many_candidates(spark):
    """Half of 20,000 forms follow the rules and half are disguised; the work is near linear in them."""
    text = " ".join(f"u{k}@x{k}.org j{k} [at] y{k}.org" for k in range(10_000))
    model = pii.train(spark.createDataFrame([], "doc_id long, text string"))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [tuple(r) for r in pii.found(frame, model).select(F.size("base"), F.size("added")).collect()] == [(10_000, 10_000)]


def test_boosted_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.random((800, len(pii.FEATURES)))
    x[:, -1] = 0
    y, held = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.6)).astype(float), np.arange(800) % 4 == 3
    model = pii.Chooser.fitted(x, y, held)
    p = model.probability(x[held])
    assert (p >= pii.PROBABLE).sum() > 40 and y[held][p >= pii.PROBABLE].mean() >= 0.95
    assert abs(p.mean() - y[held].mean()) < 0.05
    x[:, -1] = 1  # of another kind nothing was held out
    assert model.probability(x).max() < 1e-9


# --- 8 -----------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    lattice = language_id.Lattice.of(["ab", "b", "▁a", "▁", "abc", "c"])
    p = np.random.default_rng(0).random((lattice.n_pieces, 2))
    p /= p.sum(0)
    p[0] = 0
    first = len(lattice.chars) + 1

    def piece(symbols):
        return next((found[0] for size, _, found in lattice.pieces_from(np.array([symbols]), 0) if size == len(symbols)), 0)

    def log_total(symbols):
        """The exact sum in logarithms, for each language."""
        out = [np.zeros(2)]
        for end in range(1, len(symbols) + 1):
            terms = [out[at] + np.log(p[k]) for at in range(max(0, end - 4), end) if (k := piece(symbols[at:end]))]
            out.append(np.logaddexp.reduce(terms))
        return out[-1]

    words = ["abc", "ab", "cab", "b", "aéb日", "", "abc" * 40]
    codes = [lattice.codes(w) for w in words]
    assert codes[4][2:4] == [first + b for b in "é".encode()]
    assert np.allclose(lattice.log_probabilities(codes, p), [log_total(c) for c in codes])
    # a language in which a long word is far likelier doesn't push the other one out of a double's range
    flat = p.copy()
    flat[1:, 0] = 1e-8
    long = lattice.codes("abc" * 400)
    got, p = lattice.log_probabilities([long], flat)[0], flat
    assert np.allclose(got, log_total(long)) and got[0] < -7000


def test_expected_counts_are_those_of_all_segmentations():
    lattice = language_id.Lattice.of(["ab", "b", "▁a", "a"])
    p = np.random.default_rng(1).random(lattice.n_pieces)
    p[0] = 0
    code = lattice.codes("ab")
    got = lattice.expected([code], np.array([3.0]), p)
    kinds = {t: next(found[0] for size, _, found in lattice.pieces_from(np.array([[lattice.chars[c] for c in t]]), 0) if size == len(t)) for t in ("ab", "b", "▁a", "a", "▁")}
    ways = [("▁a", "b"), ("▁", "ab"), ("▁", "a", "b")]
    weight = np.array([np.prod([p[kinds[t]] for t in w]) for w in ways])
    weight = 3 * weight / weight.sum()
    want = np.zeros(lattice.n_pieces)
    for w, share in zip(ways, weight, strict=True):
        for t in w:
            want[kinds[t]] += share
    assert np.allclose(got, want)


def test_language_id(spark, docs):
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language_id.train(docs.filter(~held), public.path("piece_bpe_32k.model"))
    odd = spark.createDataFrame([(-1, None, 1), (-2, "", 1), (-3, "12 34 !", 1), (-4, "the and of", 1), (-5, "of the" * 9000, 1), (-5, "日" * 3000, 1), (None, "the", 1)], "doc_id int, text string, lang_pred int")
    out = {r.doc_id: r for r in language_id.identified(odd, model).collect()}
    assert [out[-k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and out[-4].lang_pred == "en"
    right = language_id.identified(docs.filter(held), model).join(docs.select("doc_id", "lang"), "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    print("language", right)
    assert right[0] > 0.95 and 0 <= right[1] <= right[2] <= 1
    assert language_id.identified(docs.limit(0), model).count() == 0
    # languages without spaces, of letters that the vocabulary lacks
    import random as rnd

    rng = rnd.Random(3)
    scripts = {"x1": [chr(0x1200 + k) for k in range(60)], "x2": [chr(0x1780 + k) for k in range(40)], "ja": list("のはをにがでと日本語文字人大")}
    rows = [(i, "".join(rng.choice(letters) for _ in range(400)), lang) for lang, letters in scripts.items() for i in range(20)]
    other = language_id.train(spark.createDataFrame([(k, t, lang) for k, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string"), public.path("piece_bpe_32k.model"))
    probe = spark.createDataFrame([(k, "".join(rng.choice(letters) for _ in range(60)), lang) for k, (lang, letters) in enumerate(scripts.items())], "doc_id long, text string, lang string")
    assert language_id.identified(probe, other).join(probe, "doc_id").filter("lang = lang_pred").count() == 3
    assert language_id.train(docs.limit(0), public.path("piece_bpe_32k.model")) is None
    assert language_id.identified(odd, None).filter("lang_pred != 'und'").count() == 0


# --- 9 -----------------------------------------------------------------------------------------


def test_quality_model(spark):
    dir_ = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{dir_}/documents.parquet"), spark.read.parquet(f"{dir_}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    odd = spark.createDataFrame([(-1, None, None, None, None), (-1, "", "en", "s", 0), (None, "x " * 40_000, "en", "s", None)], docs.schema)
    out = quality_model.scored(docs.unionByName(odd), labels.filter(~held))
    assert out.count() == docs.count() + 3 and out.filter("score is null or score < 0 or score > 1").count() == 0
    tested = out.join(labels.filter(held), "doc_id")
    assert tested.filter("quality = 0 and not kept").count() >= 0.8 * tested.filter("quality = 0").count()
    assert tested.filter("quality = 1 and toxic = 0 and kept").count() >= 0.95 * tested.filter("quality = 1 and toxic = 0").count()
    assert quality_model.scored(docs.limit(5), labels.limit(0)).filter("kept").count() == 5
    assert quality_model.drop_rejected(docs.limit(5), labels.limit(0)).columns == docs.columns


def test_quality_model_rejects_toxic_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    tested = quality_model.scored(docs, labels.filter(~held)).join(labels.filter(held), "doc_id").cache()
    assert tested.filter("quality = 0 and not kept").count() >= 0.8 * tested.filter("quality = 0").count()
    assert tested.filter("quality = 1 and toxic = 0 and kept").count() >= 0.95 * tested.filter("quality = 1 and toxic = 0").count()
    toxic, gone = tested.filter("toxic = 1").count(), tested.filter("toxic = 1 and not kept").count()
    print("toxic", toxic, gone)
    assert toxic and gone >= 0.8 * toxic


def test_views_teach_each_other(spark):
    """Where source says as much as words do, both views count and each has taught the other; few labels suffice."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    rows, labels = [], []
    for i in range(1500):
        good = rng.random() < 0.6
        text = " ".join(rng.choice(words[:30] if (rng.random() < 0.62) == good else words[30:]) for _ in range(30))
        rows.append((i, text, "en", f"s{rng.randrange(5) + 5 * ((rng.random() < 0.85) != good)}", 100 + i % 7))
        if i % 3 == 0:
            labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string, n_chars int").withColumn("score", F.lit("x"))
    known = spark.createDataFrame(labels, "doc_id int, quality int, toxic int")
    model = quality_model.train(docs, known)
    assert min(model.exchanged) > 0 and all(slope > 0 for slope, _ in model.views) and model.both[0] > 0
    out = {r.doc_id: r for r in quality_model.scored(docs, known, model=model).collect()}
    bad = {i for i, _, _, s, _ in rows if int(s[1:]) >= 5}
    right = lambda k: sum((getattr(out[i], k) < 0.5) == (i in bad) for i in out)
    assert right("meta_score") > 1400 and 0 < min(r.score for r in out.values()) < max(r.score for r in out.values()) < 1
    assert quality_model.drop_rejected(docs, known).columns == docs.columns
    assert quality_model.scored(docs.limit(0), known).count() == 0
    # by hand: log odds of both views less the prior, calibrated
    some = rows[:40]
    one, two, both = model.scores(pa.array([r[1] for r in some]), quality_model.meta_values([r[3] for r in some], [r[2] for r in some], [r[4] for r in some]))
    assert np.allclose(both, model.both[0] * (one + two - model.prior) + model.both[1])
    assert np.allclose([out[r[0]].score for r in some], 1 / (1 + np.exp(-both)))


def test_sparse_rows_fit_as_dense_ones():
    rng = np.random.default_rng(4)
    x = (rng.random((200, 30)) < 0.2).astype(float)
    x[:, -1] = 1
    y, weight = (x[:, 0] > x[:, 1]).astype(float), (rng.random(200) < 0.7).astype(float)
    rows = quality_model.Sparse([np.flatnonzero(r) for r in x], 30)
    used = weight > 0
    assert np.allclose(quality_model.fitted(rows, y, weight), quality_model.fitted(x[used], y[used], weight[used]))


# --- 10 ----------------------------------------------------------------------------------------


def plain_components(rows):
    sets = {}
    for i, t in rows:
        w = plain_words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(120)] for _ in range(6)]
    rows = []
    for i in range(90):
        own = list(base[i % 6])
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = word()
        rows.append((i, " ".join(own).title() if i % 4 else " ".join(own)))
    rows += [(100, None), (101, ""), (102, "a b"), (103, "A  b"), (104, "a b c d e"), (105, " \n")] + [(200 + k, "same text of six words here") for k in range(20)]
    frame = docs_of(spark, rows)
    out = {r.doc_id: r for r in near_dup.near_duplicates(frame).collect()}
    comp, sizes = plain_components(rows)
    for i, _ in rows:
        assert (out[i].component_id, out[i].n_shingles, out[i].kept) == (comp[i], sizes[i], comp[i] == i)
    kept = near_dup.drop_near_duplicates(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in comp.items() if i == c)
    again = near_dup.near_duplicates(docs_of(spark, [(None, "x y"), (1, "p q"), (1, "p q")]))
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in again.collect()) == [("1", "1", True), ("1", "1", True), ("None", "None", False)]
    assert near_dup.near_duplicates(frame.limit(0)).count() == 0


def test_row_kept_of_a_repeated_id(spark):
    rows = [(1, "a b c d e f", 5), (1, "g h i j k l", 4), (1, None, 3), (2, "a b c d e f", 9), (3, None, 8), (3, None, 7), (None, None, 1)]
    schema = "doc_id long, text string, `n.x` long"
    first = min([t for k, t, _ in rows if k == 1 and t], key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    for n in range(2):
        frame = spark.createDataFrame(random.Random(n).sample(rows, len(rows)), schema).repartition(n + 1)
        out = {r[0]: (r[1], r[2]) for r in near_dup.drop_near_duplicates(frame.withColumn("map", F.create_map(F.lit("k"), "doc_id"))).collect()}
        assert out == {1: next((t, x) for k, t, x in rows if k == 1 and t == first), 3: (None, 7), None: (None, 1)}


def test_bands_meet_at_the_threshold():
    """Pairs of similarity exactly 0.75 share a band, and unrelated long sets don't."""
    rng = np.random.default_rng(10)
    circle = near_dup.Circle()
    missed = 0
    for k in range(3000):
        part = int(rng.integers(1, 21))
        found = rng.integers(0, 2**63, 7 * part, dtype=np.int64).view(np.uint64)
        both, a, b = found[: 6 * part], found[6 * part :], rng.integers(0, 2**63, part, dtype=np.int64).view(np.uint64)
        one, two = np.concatenate([both, a]), np.concatenate([both, b])
        missed += not np.intersect1d(circle.bands(one), circle.bands(two)).size
    assert missed == 0
    far = [rng.integers(0, 2**63, 400_000, dtype=np.int64).view(np.uint64) for _ in range(2)]
    assert np.intersect1d(circle.bands(far[0]), circle.bands(far[1])).size <= 1


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    """A key of very many ids is met in parts; its links are those of all pairs."""
    monkeypatch.setattr(linking, "HOT_LEAST", 4)
    rows = spark.range(3000).select(F.when(F.col("id") < 2500, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 100).cast("string"))).alias("key"), "id", F.lit(0).alias("info"))
    assert "hot" in {r.key for r in linking.hot_keys(rows).collect()}
    same = lambda p: p.filter("a % 7 = b % 7 and a % 7 < 3")
    got = {r.id: r.comp for r in linking.linked(rows, same).collect()}
    want = {}
    by = defaultdict(list)
    for i in range(3000):
        by["hot" if i < 2500 else f"k{i % 100}"].append(i)
    root = list(range(3000))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for ids in by.values():
        for r in range(3):
            own = [i for i in ids if i % 7 == r]
            for x in own[1:]:
                root[max(find(x), find(own[0]))] = min(find(x), find(own[0]))
    sizes = Counter(find(i) for i in range(3000))
    want = {i: find(i) for i in range(3000) if sizes[find(i)] > 1}
    assert got == want


# --- the pipeline ------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir, docs):
    import corpus_pipeline

    before, frames = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf_dir).cache()
        frames[name] = after
        if name != "tokens":
            assert after.columns == docs.columns and after.count() <= before.count()
            before = after
    texts = {r.doc_id: r.text for r in frames["leaks"].collect()}
    comp, _ = plain_components([(r.doc_id, r.text) for r in frames["lines"].collect()])
    assert {r.doc_id for r in frames["near"].collect()} == {i for i, c in comp.items() if i == c}
    out = {r.doc_id: r for r in frames["tokens"].collect()}
    assert set(out) == set(texts)
    assert all(out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts.items())
    assert zlib.crc32(b"1") and all(len(r.ids) == 4 * r.n_tokens for r in out.values())


def test_pipeline_stages_with_odd_rows(spark, sf_dir, docs):
    """Nulls in any column, empty and very long texts, repeated rows and an empty table go through every stage."""
    import corpus_pipeline

    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "src0", 0), (None, "some words of a text without an id here", "en", "src0", 39), (-3, "a b c " * 30_000 + "\n" + "z" * 50_000, "en", "src1", 1), (-4, "one\ntwo three\none", "en", None, 9), (-4, "one\ntwo three\none", "en", None, 9)], docs.schema)
    clash = {c: F.lit(-5) for c in ("n_lines", "n_removed", "good", "key", "id", "comp", "rep", "kept", "score", "item_id", "words", "n_tokens", "ids")}
    for frame in (docs.limit(30).union(odd), docs.limit(0), docs.limit(20).union(odd).withColumns(clash)):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, frame, sf_dir)
            if name == "tokens":
                assert after.filter("n_tokens is null or ids is null").count() == 0 and after.count() <= frame.count()
            else:
                assert after.columns == frame.columns and after.count() <= frame.count()
                assert "good" not in frame.columns or after.filter("n_removed != -5 or id != -5").count() == 0
