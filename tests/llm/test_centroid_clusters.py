import hashlib
import math

import numpy as np
from pyspark.sql import types as T

from pressmill.llm import centroid_clusters as cc

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                       T.StructField("cluster", T.StringType()), T.StructField("x", T.StringType()),
                       T.StructField("chunk", T.StringType())])


def brute(rows, k=8, rounds=10, dim=64):
    """Lloyd's rounds on Python integers -> sorted result tuples."""
    kept = [(i, [math.floor(1024 * v) if abs(v) < 1e300 else 1024 * int(v) for v in x]) for i, x in rows
            if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, hashlib.sha256(f"3:{kept[r][0]}".encode()).hexdigest(), kept[r][1]))
    centres = [kept[r][1] for r in order[:k]]

    def assign():
        out = []
        for _, x in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centres]
            out.append((d.index(min(d)), min(d)))
        return out
    for _ in range(rounds):
        own = assign()
        for j in range(len(centres)):
            members = [x for (i, x), (a, _) in zip(kept, own) if a == j]
            if members:
                centres[j] = [sum(col) // len(members) for col in zip(*members)]
    own = assign()
    per = [sum(d for a, d in own if a == j) for j in range(len(centres))]

    def long(v):
        return v if v < 1 << 63 else None
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted([(i, a, long(d), long(per[a]), long(sum(per)), shas[a]) for (i, _), (a, d) in zip(kept, own)], key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, x, "a", "b", "c") for i, x in rows], SCHEMA)
    return sorted(map(tuple, cc.cluster(df, **kw).collect()), key=str)


def blobs(rng, n, dim, spread=0.3):
    centres = rng.normal(size=(12, dim))
    return [(int(i), (centres[rng.integers(12)] + spread * rng.normal(size=dim)).tolist()) for i in range(n)]


def test_bounds_hold_and_save_rescans():
    rng = np.random.default_rng(1)
    x = cc.integers(np.array([v for _, v in blobs(rng, 600, 16)]))
    history, chunk, scanned = [x[:8].copy()], cc.Chunk(x), []
    for _ in range(12):
        chunk.assign(history)
        scanned.append(chunk.rescans)
        d2 = ((x[:, None] - history[-1][None]) ** 2).sum(-1)
        assert (chunk.own == d2.argmin(axis=1)).all()
        moved = cc.displacements(history)[chunk.since, np.arange(8)]
        assert (chunk.dist - moved - 1e-6 <= np.sqrt(d2)).all() and (np.sqrt(d2) <= chunk.dist + moved + 1e-6).all()
        sums = {(j, d): int(chunk.sums[j, d]) for j in range(8) for d in range(17)}
        assert [sums[j, 16] for j in range(8)] == np.bincount(chunk.own, minlength=8).tolist()
        assert (chunk.sums[:, :-1] == np.stack([x[chunk.own == j].sum(axis=0) for j in range(8)])).all()
        history.append(cc._next(history[-1], sums))
    assert scanned[0] == 600 * 8 and min(scanned) < 600 * 2


def test_displacement_is_the_norm_of_the_whole_way():
    there, back = np.zeros((1, 2), np.int64), np.array([[30, 40]])
    assert cc.displacements([there, back, there]).ravel().tolist() == [0.0, 50.0, 0.0]  # summed drifts would say 100


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = blobs(rng, 400, 64)
    assert run(spark, rows, chunk=37) == brute(rows)
    grid = [(i, [float(v) / 1024 for v in rng.integers(-1, 2, 2)]) for i in range(120)]  # many ties and equal vectors
    for k in (1, 3, 8):
        assert run(spark, grid, dim=2, k=k, chunk=10) == brute(grid, dim=2, k=k)


def test_nulls_lengths_non_finite_repeats_huge_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    rows = blobs(rng, 40, 4)
    rows += rows[:5] + [(None, [0.5] * 4), (None, [0.25] * 4), (50, None), (51, []), (52, [1.0] * 3), (53, [1.0] * 5),
                        (54, [1.0, None, 1.0, 1.0]), (55, [1.0, float("nan"), 0.0, 0.0]), (56, [float("inf")] * 4), (3, [0.0] * 4)]
    assert run(spark, rows, dim=4, chunk=7) == brute(rows, dim=4)
    huge = rows + [(60, [3e38, -3e38, 0.0, 1.0]), (61, [1e6, 2e8, -5e9, 0.1]), (62, [1.5e308] * 4)]
    assert run(spark, huge, dim=4, chunk=7) == brute(huge, dim=4)
    assert run(spark, rows[:3], dim=4) == brute(rows[:3], dim=4)  # fewer vectors than clusters
    assert run(spark, [], dim=4) == [] and run(spark, [(1, None)], dim=4) == []
    assert run(spark, [(7, [1.0] * 4)] * 20, dim=4) == brute([(7, [1.0] * 4)] * 20, dim=4)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, cc.op11_centroid_clusters(spark, sf).collect()), key=str) == brute(rows)
