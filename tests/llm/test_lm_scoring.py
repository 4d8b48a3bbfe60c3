import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill.llm import lm_scoring as lm

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("tie", T.StringType()), T.StructField("score", T.StringType())])


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    return out


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(2)
    counts = np.zeros(lm.subwords(lm.RANK_FILE).size)
    counts[:300] = rng.integers(1, 1000, 300)
    voc = lm.Vocabulary(counts)
    return voc, lm.Network.start(voc)


def test_gradient_against_differences(model):
    voc, net = model
    rng = np.random.default_rng(1)
    x_at, y, real, _ = lm.windows(rng.integers(0, 300, 70), np.array([40, 1, 29]))
    _, g = net.gradient(x_at, y, real)
    for j in rng.choice(np.flatnonzero(np.abs(g) > 1e-2), 15):
        up, down = net.flat.copy(), net.flat.copy()
        up[j] += 1e-2
        down[j] -= 1e-2
        slope = (lm.Network(up).gradient(x_at, y, real)[0] - lm.Network(down).gradient(x_at, y, real)[0]) / 2e-2
        assert math.isclose(slope, g[j], rel_tol=0.05, abs_tol=2e-3)


def test_probabilities_sum_to_one_and_do_not_see_ahead(model):
    voc, net = model
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 300, 20)
    x_at, y, real, _ = lm.windows(ids, np.array([20]))
    h, _ = net.forward(x_at)
    every = np.arange(lm.PLACES)
    for place in (0, 7, 19):
        logs = net.log_probabilities(np.repeat(h[place:place + 1], len(every), axis=0), every)
        assert math.isclose(np.exp(logs).sum(), 1.0, rel_tol=1e-4)
    assert (voc.inner == 0).all()  # fewer ids than places: none is shared
    larger = lm.Vocabulary(rng.integers(0, 9, 60_000).astype(float))
    shared = larger.place_of == lm.PLACES - 1
    assert shared.sum() == 60_000 - lm.PLACES + 1
    assert math.isclose((10 ** larger.inner)[shared].sum(), 1.0, rel_tol=1e-6)
    changed = ids.copy()
    changed[10:] = rng.integers(0, 300, 10)
    other, _ = net.forward(lm.windows(changed, np.array([20]))[0])
    assert np.allclose(h[:11], other[:11], atol=1e-5) and not np.allclose(h[12:20], other[12:20], atol=1e-5)


def plain_score(voc, net, ids):
    """log10 probability of a text's ids, token by token: each attends to the places of its own window before it."""
    w = {name: x.astype(np.float64) for name, x in net.w.items()}
    places = [int(voc.place_of[i]) for i in ids]
    fed = [lm.START] * (lm.WINDOW - lm.FRESH + 1) + places
    total = sum(voc.inner[i] for i in ids)
    for i, y in enumerate(places):
        first = i // lm.FRESH * lm.FRESH
        own = lm.WINDOW - lm.FRESH + i - first
        x = np.array([w["embed"][fed[first + j]] + w["place"][j] for j in range(own + 1)])
        a = (x @ w["wk"]) @ (x[-1] @ w["wq"]) / math.sqrt(lm.WIDTH)
        a = np.exp(a - a.max())
        h = x[-1] + (a / a.sum()) @ (x @ w["wv"]) @ w["wo"]
        h = h + np.maximum(h @ w["w1"] + w["b1"], 0) @ w["w2"]
        levels = [(w["group"], y // lm.SIDE ** 2), (w["branch"][y // lm.SIDE ** 2], y // lm.SIDE % lm.SIDE),
                  (w["member"][y // lm.SIDE], y % lm.SIDE)]
        for weights, choice in levels:
            logits = h @ weights[:-1] + weights[-1]
            total += (logits[choice] - logits.max() - math.log(np.exp(logits - logits.max()).sum())) / math.log(10)
    return total


def test_scores_against_plain_attention(model):
    voc, net = model
    sub = lm.subwords(lm.RANK_FILE)
    texts = ["", "one word", "A text that runs over several windows " * 12, None, "zebra \u00e9t\u00e9 \U0001f600 " * 9]
    # the second time with weights so large that exponentials would overflow
    for flat in (net.flat, net.flat * 40):
        scores = lm.Scorer(voc, flat, lm.RANK_FILE).score(texts)
        for t, got in zip(texts, scores):
            want = plain_score(voc, lm.Network(flat), sub.text(lm.words_of(t)))
            assert math.isclose(got, want, rel_tol=1e-3), (t, got, want)


def test_averaging_weighs_rows_by_their_steps_and_keeps_untouched_ones(spark):
    voc = lm.Vocabulary(np.ones(lm.subwords(lm.RANK_FILE).size))
    rows = spark.createDataFrame([(1, "one two three " * 50)], "doc_id long, text string")
    flat, start = lm.train_network(rows, voc, lm.RANK_FILE, 150), lm.Network.start(voc).flat
    embed = lm.Network(flat).w["embed"] != lm.Network(start).w["embed"]
    used = {int(voc.place_of[i]) for i in lm.subwords(lm.RANK_FILE).text(lm.words_of("one two three"))} | {lm.START}
    assert set(np.flatnonzero(embed.any(axis=1)).tolist()) <= used
    assert (flat[:lm.DENSE_SIZE] != start[:lm.DENSE_SIZE]).any()


def test_windows_score_each_token_once_with_its_context():
    rng = np.random.default_rng(4)
    sizes = np.array([1, lm.FRESH, lm.FRESH + 1, 100, 3])
    ids = rng.integers(0, 50, sizes.sum())
    x_at, y, real, text = lm.windows(ids, sizes)
    assert real.sum() == len(ids) and (np.bincount(text[real]) == sizes).all() and (y[real] == ids).all()
    begin = np.cumsum(sizes) - sizes
    for k, n in enumerate(sizes):
        rows = np.flatnonzero(text[::lm.FRESH] == k)
        padded = [lm.START] * (lm.WINDOW - lm.FRESH + 1) + ids[begin[k]:begin[k] + n].tolist()
        for i, r in enumerate(rows):
            want = padded[i * lm.FRESH:i * lm.FRESH + lm.WINDOW]
            got = x_at[r][:len(want)].tolist()
            m = min(len(want), len(padded) - 1 - i * lm.FRESH)
            assert got[:m] == want[:m]


def test_base_columns_and_learning_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = {r.doc_id: r for r in lm.op5_lm_scoring(spark, sf).collect()}
    assert len(rows) == len(docs)
    counts = Counter()
    for d in docs:
        if zlib.crc32(str(d.doc_id).encode()) % 10:
            counts.update([*words(d.text), ""])
    total, distinct = sum(counts.values()), len(counts)
    for d in docs:
        r, tokens = rows[d.doc_id], [*words(d.text), ""]
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (zlib.crc32(str(d.doc_id).encode()) % 10 == 0, len(tokens), total)
        assert r.n_known == sum(counts[t] > 0 for t in tokens)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0


def test_training_lowers_held_out_loss():
    sub = lm.subwords(lm.RANK_FILE)
    rng = np.random.default_rng(0)
    lexicon = ["alpha beta", "gamma delta", "the end of it", "one two three four"]
    texts = [sub.text(lm.words_of(" ".join(rng.choice(lexicon, 60)))) for _ in range(60)]
    voc = lm.Vocabulary(np.bincount(np.concatenate(texts), minlength=sub.size).astype(float))
    start = lm.Network.start(voc).flat
    learned = lm.train_locally(start, voc, texts[:50], 0.01, 150, 1)
    held = [" ".join(rng.choice(lexicon, 60)) for _ in range(5)]
    before, after = (lm.Scorer(voc, f, lm.RANK_FILE).score(held).sum() for f in (start, learned))
    assert after > 0.6 * before  # scores are negative


def test_nulls_rare_words_repeated_rows_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_STEPS", 2)
    monkeypatch.setattr(lm.hot_words, "__defaults__", (2,))  # most words meet their counts in the join
    df = spark.createDataFrame([(1, None, "x", "y"), (None, "", "x", "y"), (2, "a b a \x00 rare", "x", "y"),
                                (2, "a b a \x00 rare", None, None), (2, "other", "x", "y"), (7, "unseen words", "x", "y"),
                                (8, "long " * 40_000, "x", "y")], SCHEMA)
    learn = ~F.coalesce(F.col("doc_id") == 7, F.lit(False))
    rows = lm.score_texts(df, learn).collect()
    assert len(rows) == 7
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in rows) == [
        (0, 1, 1), (1, 1, 1), (2, 2, 2), (2, 6, 6), (2, 6, 6), (7, 3, 1), (8, 40_001, 40_001)]
    by = {(r.doc_id, r.n_tokens): r for r in rows}

    total = by[2, 6].train_tokens
    assert total == 40_001 + 1 + 1 + 6 + 6 + 2
    distinct = len({"a", "b", "\x00", "rare", "other", "long", ""})
    want = sum(math.log10((c + 0.1) / (total + 0.1 * (distinct + 1))) for c in (4, 2, 4, 2, 2, 6))
    assert math.isclose(by[2, 6].base_score, want, rel_tol=1e-9)
    assert lm.score_texts(df.limit(0), learn).collect() == []
    none = lm.score_texts(df, F.lit(False)).collect()
    assert len(none) == 7 and all(r.n_known == 0 and r.train_tokens == 0 and r.held_out for r in none)


def test_every_learning_row_trains_the_network(spark):
    sub = lm.subwords(lm.RANK_FILE)
    df = spark.range(200).where(F.pmod(F.xxhash64("id", F.lit(lm.SEED)), F.lit(48)) != 0).limit(30)
    # rows that one in 48 leaves out; the last has a pattern of its own
    ids = sorted(r.id for r in df.collect())
    docs = [(d, "one two three " * 20) for d in ids[:-1]] + [(ids[-1], "purple elephants dance quietly " * 20)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    voc = lm.Vocabulary(np.bincount(np.concatenate([sub.text(lm.words_of(t)) for _, t in docs]), minlength=sub.size).astype(float))
    flat = lm.train_network(rows, voc, lm.RANK_FILE, sum(len(t.split()) for _, t in docs))
    start = lm.Network.start(voc).flat
    texts = ["one two three " * 5, "purple elephants dance quietly " * 5]
    before, after = (lm.Scorer(voc, f, lm.RANK_FILE).score(texts) for f in (start, flat))
    assert (after > before + 1).all()


def test_rare_ids_have_places_of_their_own():
    counts = np.zeros(50_258)
    counts[:20_000] = np.arange(20_000, 0, -1)
    places = lm.Vocabulary(counts).place_of[:20_000]
    assert len(set(places.tolist())) == 20_000


def test_words_encoded_together_have_the_ids_of_each_alone(spark):
    sub = lm.subwords(lm.RANK_FILE)
    plain = ["a", "it's're", "'s", "12ab", "--", "\x1c", "a\x00b", "été", "\U0001f600", "​z"]
    spaced = ["\xa0", "\x85a", "b　", "c d", "  "]  # white space, though not ASCII's: it stays in a word
    rng = np.random.default_rng(7)
    for some in ([], plain, spaced, plain + spaced, *(rng.choice(plain + spaced, 6).tolist() for _ in range(200))):
        each = [i for w in some for i in sub.lib.encode_ordinary(" " + w)]
        got = sub.text([w.encode() for w in some])
        assert got.dtype == np.uint32 and got.tolist() == [*each, sub.end]
    for some in (plain, spaced):
        counts = spark.createDataFrame([(w.encode(), n) for n, w in enumerate(["", *some], 1)], "word binary, c long")
        want = np.zeros(sub.size)
        want[sub.end] = 1
        for n, w in enumerate(some, 2):
            np.add.at(want, sub.lib.encode_ordinary(" " + w), n)
        assert (lm.subword_counts(counts, lm.RANK_FILE) == want).all()


def test_texts_are_encoded_in_one_call():
    sub, calls = lm.Subwords(lm.RANK_FILE), []

    class Counted:
        def encode_ordinary(self, text):
            calls.append(text)
            return lm.subwords(lm.RANK_FILE).lib.encode_ordinary(text)

    sub.lib = Counted()
    sub.text(lm.words_of("Every word of a text, été too"))
    assert calls == [" every word of a text, été too"]
