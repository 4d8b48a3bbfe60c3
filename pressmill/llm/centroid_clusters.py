"""Exact integer k-means with ns-bounds.

Every vector keeps, per centroid, its distance at the round of their last evaluation. Centroids of all
rounds are retained, so a stored distance is loosened by the norm of the centroid's total displacement
since that round (not by the sum of its moves, which is never smaller): d - |shift| is a lower, d + |shift| an upper
bound. A centroid whose lower bound stands above the upper bound of the vector's own centroid cannot be
nearest, not even in a tie; all others are evaluated again, exactly, on integers.

Vectors are packed into chunks of a few thousand, one row each, with their bounds and their clusters' sums.
A round is one narrow pass over the chunks, kept by ``persist`` until the next one has been made: a
lost executor's chunks are made again from the table by at most ``rounds`` passes over
those chunks alone, nothing is shuffled, and only exact sums (one number per cluster, component and
limb) meet on the driver. A vector that stays costs its bounds only: the sums change by what moves.

Defined results: a vector is left out if it is null, has another number of components than ``dim``, or a null or
non-finite one. Repeated rows are separate vectors. Start centroids are ordered by the hash of their id, ties by the vector;
a null id sorts last. With fewer vectors than ``k`` there are as many clusters as vectors. Components of 2**27 and
more are computed with Python's integers; a distance or inertia beyond a long is null. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import materialize, prepare, read

K = 8
ROUNDS = 10
DIM = 64
SCALE = 1024
SEED = "3"
CHUNK = 4096
#: Below this, squared distances over DIM components fit in 64 bits.
PLAIN = 1 << 27
#: Relative and absolute room for rounding in the bounds.
REL, ABS = 1e-12, 1e-9
_LIMB = 60


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): int64 where all of them are below ``PLAIN``, Python integers otherwise."""
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * values)
    if not values.size or np.abs(scaled).max() < PLAIN:
        return scaled.astype(np.int64)
    flat = [math.floor(scale * x) if abs(x) < 1e300 else scale * int(x) for x in values.ravel().tolist()]
    return np.array(flat + [None], dtype=object)[:-1].reshape(values.shape)


def _plain(a: np.ndarray) -> bool:
    return a.dtype != object and (not a.size or int(np.abs(a).max()) < PLAIN)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = x - c
    return (d * d).sum(axis=-1)


def displacements(history: list[np.ndarray]) -> np.ndarray:
    """[t, j]: how far centroid j has come since round t."""
    now = history[-1]
    return np.array([[math.sqrt(int(v)) for v in squared(now, then)] for then in history])


class Chunk:
    """Vectors with their clusters and bounds."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.own = self.dist = self.since = self.sums = None
        self.rescans = 0

    def assign(self, history: list[np.ndarray]) -> None:
        """One round of assignment to the last centroids of ``history``."""
        c, t, n = history[-1], len(history) - 1, len(self.x)
        before = self.own
        if not _plain(self.x) or not _plain(c):  # no bounds on numbers of any size
            d2 = np.array([[int(v) for v in squared(row, c)] for row in self.x], dtype=object).reshape(n, len(c))
            self.own = np.array([min(range(len(c)), key=lambda j: (row[j], j)) for row in d2], np.int16)
            self.dist = None
        elif self.dist is None:
            d2 = np.stack([squared(self.x, c[j]) for j in range(len(c))], axis=1)
            self.rescans = d2.size
            self.own = d2.argmin(axis=1).astype(np.int16)
            self.dist, self.since = np.sqrt(d2.astype(np.float64)), np.full(d2.shape, t, np.int16)
        else:
            self._by_bounds(c, t, displacements(history))
        self._move(before, len(c))

    def _by_bounds(self, c: np.ndarray, t: int, moved: np.ndarray) -> None:
        rows, cols = np.arange(len(self.x)), np.arange(len(c))
        shift = moved[self.since, cols]
        room = REL * (self.dist + shift) + ABS
        lower, upper = self.dist - shift - room, (self.dist + shift + room)[rows, self.own]
        lower[rows, self.own] = np.inf
        near = np.flatnonzero((lower <= upper[:, None]).any(axis=1))
        # the distance to the own centroid first: it may settle the rest
        best = squared(self.x[near], c[self.own[near]])
        self._seen(near, self.own[near], best, t)
        own = np.sqrt(best.astype(np.float64))
        again = lower[near] <= (own + REL * own + ABS)[:, None]
        own_j = self.own[near].copy()
        self.rescans = len(near) + int(again.sum())
        for j in cols:
            at = np.flatnonzero(again[:, j])
            if not len(at):
                continue
            d2 = squared(self.x[near[at]], c[j])
            self._seen(near[at], j, d2, t)
            better = (d2 < best[at]) | ((d2 == best[at]) & (j < own_j[at]))
            best[at[better]], own_j[at[better]] = d2[better], j
        self.own = self.own.copy()
        self.own[near] = own_j

    def _seen(self, rows, cols, d2, t) -> None:
        self.dist[rows, cols] = np.sqrt(d2.astype(np.float64))
        self.since[rows, cols] = t

    def _move(self, before, k: int) -> None:
        """Keep the clusters' sums and counts (last column) up to date."""
        if self.sums is None:
            self.sums = np.zeros((k, self.x.shape[1] + 1), self.x.dtype)
            moved = np.arange(len(self.x))
        else:
            moved = np.flatnonzero(before != self.own)
        for j in range(k):
            come = self.x[moved[self.own[moved] == j]]
            self.sums[j, :-1] += come.sum(axis=0) if len(come) else 0
            self.sums[j, -1] += len(come)
            if before is not None:
                gone = self.x[moved[before[moved] == j]]
                self.sums[j, :-1] -= gone.sum(axis=0) if len(gone) else 0
                self.sums[j, -1] -= len(gone)


def _kept(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    x = F.col(vec_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return df.where(x.isNotNull() & (F.size(x) == dim) & ~bad).select(F.col(id_col).alias("vec_id"),
                                                                      x.cast("array<double>").alias("x"))


def _starts(kept: DataFrame, k: int, seed: str, scale: int, dim: int) -> np.ndarray:
    """The first centroids: at most ``k`` rows come to the driver."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.withColumn("h", rank).orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    return integers(np.array([r.x for r in first], np.float64).reshape(len(first), dim), scale)


def _packed(kept: DataFrame, id_type: str, scale: int, dim: int, chunk: int) -> DataFrame:
    def run(batches):
        ids, xs = [], []

        def flush():
            table = pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(id_arrow)),
                 pa.array([pickle.dumps(Chunk(integers(np.array(xs, np.float64).reshape(len(xs), dim), scale)))], pa.binary())],
                names=["ids", "chunk"])
            ids.clear()
            xs.clear()
            return table

        for b in batches:
            id_arrow = b.schema.field(0).type
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                xs.append(x)
                if len(ids) == chunk:
                    yield flush()
        if ids:
            yield flush()

    return kept.mapInArrow(run, f"ids array<{id_type}>, chunk binary")


def _assigned(chunks: DataFrame, history: list[np.ndarray], id_type: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for at, blob in enumerate(b.column(1).to_pylist()):
                chunk = pickle.loads(blob)
                chunk.assign(history)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 1), pa.array([pickle.dumps(chunk)], pa.binary())],
                                                 names=["ids", "chunk"])

    return chunks.mapInArrow(run, f"ids array<{id_type}>, chunk binary")


def _sums(chunks: DataFrame) -> dict:
    """(cluster, component) -> exact sum; numbers are added in limbs of 60 bits, so they may have any size."""
    def run(batches):
        total = None
        for b in batches:
            for blob in b.column(0).to_pylist():
                sums = pickle.loads(blob).sums.astype(object)
                total = sums if total is None else total + sums
        if total is None:
            return
        rows = []
        for (j, d), v in np.ndenumerate(total):
            v, limb = int(v), 0
            while not -(1 << 62) < v < 1 << 62:
                rows.append((j, d, limb, v & ((1 << _LIMB) - 1)))
                v, limb = v >> _LIMB, limb + 1
            rows.append((j, d, limb, v))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                                         names=["cluster", "d", "limb", "v"])

    limbs = chunks.select("chunk").mapInArrow(run, "cluster int, d int, limb int, v long")
    out: dict = {}
    for r in limbs.groupBy("cluster", "d", "limb").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        out[r.cluster, r.d] = out.get((r.cluster, r.d), 0) + (int(r.v) << (_LIMB * r.limb))
    return out


def _next(centroids: np.ndarray, sums: dict) -> np.ndarray:
    k, dim = centroids.shape
    rows = [[sums.get((j, d), 0) // sums[j, dim] for d in range(dim)] if sums.get((j, dim)) else centroids[j].tolist()
            for j in range(k)]
    small = all(-PLAIN < v < PLAIN for row in rows for v in row)
    return np.array(rows, np.int64 if small else object)


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS,
            dim: int = DIM, scale: int = SCALE, seed: str = SEED, chunk: int = CHUNK) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    spark = prepare(df.sparkSession)
    kept = _kept(df, id_col, vec_col, dim)
    id_type = kept.schema["vec_id"].dataType.simpleString()
    history = [_starts(kept, k, seed, scale, dim)]
    chunks = _packed(kept, id_type, scale, dim, chunk)
    made = None
    for _ in range(rounds if len(history[0]) else 0):
        chunks = _assigned(chunks, list(history), id_type).persist()
        history.append(_next(history[-1], _sums(chunks)))
        if made is not None:
            made.unpersist()
        made = chunks
    final = list(history)

    def run(batches):
        for b in batches:
            for ids, blob in zip(b.column(0), b.column(1).to_pylist()):
                part = pickle.loads(blob)
                part.assign(final)
                d2 = [int(v) for v in squared(part.x, final[-1][part.own])]
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(part.own, pa.int32()),
                     pa.array([v if v < 1 << 63 else None for v in d2], pa.int64())],
                    names=["vec_id", "cluster", "distance"])

    assigned = materialize(chunks.mapInArrow(run, f"vec_id {id_type}, cluster int, distance long"))
    if made is not None:
        made.unpersist()

    # one row per cluster: exact sums, no sum where a distance has none
    per = {r.cluster: r for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"), F.count("distance").alias("v")).collect()}

    def long(rows):
        known = all(r.n == r.v for r in rows) and sum(int(r.s) for r in rows)
        return known if known is not False and known < 1 << 63 else None

    inertia = long(per.values())
    facts = spark.createDataFrame(
        [(j, long([r]), inertia, hashlib.sha256(",".join(str(int(v)) for v in final[-1][j]).encode()).hexdigest())
         for j, r in per.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                                               "centroid_sha256")


def op11_centroid_clusters(spark, sf_dir) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def _oracle() -> str:
    """The rounds written out: assignment a0, centroids c1, ... a10."""
    def assign(r):
        return f"""a{r} AS MATERIALIZED (
  SELECT rid, j, dist FROM (
    SELECT rid, j, dist, row_number() OVER (PARTITION BY rid ORDER BY dist, j) AS place FROM (
      SELECT x.rid, c.j, sum((x.v - c.v) * (x.v - c.v)) AS dist FROM x JOIN c{r} c USING (d) GROUP BY x.rid, c.j))
  WHERE place = 1)"""

    def move(r):
        return f"""c{r + 1} AS MATERIALIZED (
  SELECT c.j, c.d, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.v) AS v
  FROM c{r} c LEFT JOIN (SELECT a.j, x.d, sum(x.v)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r} a JOIN x USING (rid)
                         GROUP BY a.j, x.d) m USING (j, d))"""

    steps = [s for r in range(ROUNDS) for s in (assign(r), move(r))] + [assign(ROUNDS)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {DIM}),
x AS MATERIALIZED (
  SELECT rid, d, floor({SCALE} * CAST(embedding[d] AS DOUBLE))::HUGEINT AS v FROM kept, range(1, {DIM + 1}) r(d)),
c0 AS MATERIALIZED (
  SELECT k.j, x.d, x.v FROM (
    SELECT rid, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, embedding) - 1 AS j FROM kept) k
  JOIN x USING (rid) WHERE k.j < {K}),
{", ".join(steps)},
sha AS (SELECT j, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY j)
SELECT k.vec_id, a.j::INTEGER AS cluster, a.dist::BIGINT AS distance,
       (sum(a.dist) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(a.dist) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{ROUNDS} a JOIN kept k USING (rid) JOIN sha USING (j)
"""


OP11_SQL = _oracle()
