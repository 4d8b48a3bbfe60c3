import random

import numpy as np
import pytest
from pyspark.sql import types as T

from pressmill.llm import near_dedup as nd

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("n_shingles", T.StringType()), T.StructField("component", T.StringType())])
BLANKS = " \t\n\x0b\x0c\r"


def shingle_set(text, size):
    words, word = [], ""
    for c in text or "":
        if c in BLANKS:
            if word:
                words.append(word)
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    if word:
        words.append(word)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(docs, size, threshold=80):
    sets = {d: shingle_set(t, size) for d, t in docs}
    ids = sorted(sets)
    parent = {d: d for d in ids}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= threshold * max(len(x), len(y)):
                common = len(x & y)
                if 100 * common >= threshold * (len(x) + len(y) - common):
                    ra, rb = root(a), root(b)
                    parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in ids}


def variants(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_groups_against_brute_force(spark, size):
    rng = random.Random(size)
    texts = []
    for _ in range(8):  # chains and stars of near copies, some just below the threshold
        base = [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(30, 120))]
        texts += variants(rng, base, 25, len(base) // 12)
    texts += ["", None, "One", "one", "ONE ", "two words", "Two\nwords", "a b c d", "a b c d e", "é É"]
    rng.shuffle(texts)
    docs = [(i * 7, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], SCHEMA).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_groups(df, size=size).collect()}
    assert got == brute(docs, size)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = nd.op4_near_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(docs, 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_large_family_meets_in_blocks(spark, monkeypatch):
    # many members below the threshold to the smallest id, some linked only among themselves
    monkeypatch.setattr(nd, "BLOCK_WEIGHT", 1500)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = variants(rng, base, 120, 9)
    for t in list(texts[:30]):
        texts += variants(rng, t.split(), 2, 6)
    docs = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in nd.near_groups(spark.createDataFrame([(*d, "x", "y") for d in docs], SCHEMA), size=2).collect()}
    want = brute(docs, 2)
    assert len({c for _, c in want.values()}) > 3
    assert got == want


def test_components_of_chains_rings_and_hubs(spark):
    rng = random.Random(0)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 80)] + [(300, 301), (301, 302), (302, 300)]
    links += [(400 + rng.randint(0, 60), 400 + rng.randint(0, 60)) for _ in range(50)]
    rng.shuffle(links)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.id: r.component for r in nd.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {x: root(x) for x in parent if root(x) != x}
    assert got == want


def test_nulls_repeated_rows_long_and_empty_tables(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([(None, "a b c", "x", "y"), (None, "a b c", "x", "y"), (1, long, "x", "y"), (2, long + " tail", "x", "y"),
                                (3, None, "x", "y"), (4, "", None, None), (5, "a b c", "x", "y"), (5, "a b c", "x", "y")], SCHEMA)
    rows = nd.near_groups(df, size=2).collect()
    assert len(rows) == 8
    assert {(r.doc_id, r.component_id, r.kept) for r in rows} == {
        (None, None, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True)}
    assert nd.near_groups(df.limit(0)).collect() == []
    left = nd.drop_near_copies(df, size=2)
    assert left.columns == df.columns and left.count() == 7


def test_minhash_agreement_estimates_similarity():
    s = nd.Sketcher(2, 64, 3)
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        pool = rng.integers(1, 1 << 62, 4_000).astype(np.uint64)
        common = int(2_000 * 2 * share / (1 + share))
        a, b = pool[:2_000], np.concatenate([pool[:common], pool[2_000:4_000 - common]])
        agree = (s.minhashes(np.unique(a)) == s.minhashes(np.unique(b))).mean()
        assert abs(agree - share) < 0.09
