import random
import zlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import types as T
from tokenizers import Tokenizer

from pressmill.llm import packing as pk

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("offset", T.StringType()), T.StructField("_class", T.StringType())])


def check_layout(rows, capacity):
    """Every document's pieces and every sequence are gapless and in bounds."""
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


def test_query_against_tokenizers(spark):
    sf = "/root/testdata/sf0.001"
    rows = pk.op10_packing(spark, sf).collect()
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(docs)
    total = 0
    for d, text in docs.items():
        ids = np.array(lib.encode(text, add_special_tokens=False).ids + [1], "<u4")
        total += len(ids)
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    n = check_layout(rows, 2048)
    assert n <= -(-total // 2048) * 1.06 + 2


def test_special_marks_and_odd_blanks_match_the_library():
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own = pk.tokens(P.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    texts = ["", " ", "a<|endoftext|>b  c <|endoftext|>", "<|endoftext|>", " x", "x ", "a \n b", "é  ü\t\t z", "1 2  3"]
    texts += ["".join(rng.choice(["ab", " ", "  ", "\n", "é", "7", "!?", "<|endoftext|>", " ", "\x1c"])
                      for _ in range(40)) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids + [1], repr(t)


def test_nulls_ties_long_and_empty_tables(spark):
    long = "word " * 30_000
    df = spark.createDataFrame([(1, None, "x", "y"), (2, "", None, None), (3, long, "x", "y"), (3, long, "x", "y"),
                                (None, "same", "x", "y"), (None, "same", "x", "y")], SCHEMA)
    rows = pk.pack(df, capacity=256, unit=8).collect()
    check_layout(rows, 256)
    assert sum(r.length for r in rows if r.doc_id == 3) == 2 * rows[[r.doc_id for r in rows].index(3)].doc_tokens
    assert [r.length for r in rows if r.doc_id in (1, 2)] == [1, 1]
    assert sum(r.doc_id is None for r in rows) == 2
    assert pk.pack(df.limit(0)).collect() == []


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(4)
    sizes = np.arange(1, 65)
    demand = rng.integers(0, 5_000, 64)
    plan = pk.plan_sequences({int(s): int(d) for s, d in zip(sizes, demand) if d}, 64 * 16, 16)
    used = {}
    for c, first, last, per, seq, _ in plan:
        assert (last - first + 1) % per == 0
        for k in range((last - first + 1) // per):
            used[seq + k] = used.get(seq + k, 0) + c * per
    assert max(used.values()) <= 64
    assert sum(used.values()) == int((sizes * demand).sum())
    assert len(used) <= (sizes * demand).sum() / 64 * 1.01 + 20


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes, values = rng.integers(1, 9, 4), rng.random(4)
        best = 0.0
        for a in range(13):
            for b in range(13):
                for c in range(13):
                    for d in range(13):
                        n = np.array([a, b, c, d])
                        if n @ sizes <= 12:
                            best = max(best, float(n @ values))
        value, counts = pk.knapsack(values, sizes, 12)
        assert abs(value - best) < 1e-9 and counts @ sizes <= 12 and abs(counts @ values - best) < 1e-9


def test_solver_beyond_its_refresh_beside_a_session(spark):
    """More than 100 steps, so the basis is inverted anew, with a live session and default threads, under a time limit."""
    import subprocess
    import sys
    rng = np.random.default_rng(5)
    m = rng.normal(size=(128, 128)) + 8 * np.eye(128)
    assert np.abs(pk.inverse_of(m) @ m - np.eye(128)).max() < 1e-9
    code = """
import sys
import numpy as np
sys.path.insert(0, ".")
from pressmill.session import build_session
from pressmill.llm import packing as pk
spark = build_session("local[2]", 2)
assert spark.range(10).count() == 10
calls = []
inverse_of = pk.inverse_of
pk.inverse_of = lambda m: calls.append(1) or inverse_of(m)
rng = np.random.default_rng(5)
sizes = np.arange(1, 129)
demand = rng.integers(1, 4000, 128).astype(float)
patterns, x = pk.solve_patterns(sizes, demand, 128, gap=0.0, patience=400)
assert calls and np.allclose((patterns * x).sum(axis=1), demand, atol=1e-5), len(calls)
print("steps done", len(calls))
spark.stop()
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=180)
    assert "steps done" in done.stdout, done.stderr[-2000:]
