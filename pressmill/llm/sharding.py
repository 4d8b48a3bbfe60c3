"""Uniform shuffle into shards of exact size, by a communication matrix.

Rows are dealt to blocks by a hash of their id. The number of rows that each
block sends to each shard is drawn exactly, from the multivariate hypergeometric
law that a uniform permutation of all rows would give, so the shards' sizes are
fixed beforehand (``rows`` law: at most one apart). Within its block a row's
place in a pseudo-random order decides which part of the block's matrix row it
falls in; after the exchange each shard is put in a second pseudo-random order.

Only counts reach the driver: one per block in, ``shards`` per block out. No
window holds a whole shard: a shard's order is its hash range, cut into
pieces, and slots are a piece's offset plus the place within the piece.

Defined results: a null text has size 16 and crc 0; a null id is an id like
any other; repeated rows are separate rows, each with its own slot.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressmill.llm.common import materialize, prepare, read

SHARDS = 40
#: Upper bound of the rows that one task puts in order.
BLOCK_ROWS = 500_000
#: Blocks there are at least, so that small tables spread over a cluster too.
LEAST_BLOCKS = 64
SEED = 20240229


def communication_matrix(block_rows: list[int], shards: int, seed: int) -> np.ndarray:
    """counts[b, s]: rows that block b sends to shard s; row sums are
    ``block_rows``, column sums are at most one apart."""
    total = int(sum(block_rows))
    rng = np.random.default_rng(seed)
    left = np.full(shards, total // shards, dtype=np.int64)
    left[rng.permutation(shards)[: total % shards]] += 1
    out = np.zeros((len(block_rows), shards), dtype=np.int64)
    # numpy draws up to 10**9 rows at once; beyond it, shard by shard
    for b, n in enumerate(block_rows):
        out[b] = _draw(rng, left, int(n))
        left -= out[b]
    return out


def _draw(rng, left: np.ndarray, n: int) -> np.ndarray:
    if left.sum() < 1_000_000_000:
        return rng.multivariate_hypergeometric(left, n, method="marginals")
    drawn, rest = np.zeros_like(left), int(left.sum())
    for s, m in enumerate(left):
        rest -= int(m)
        if n == 0:
            break
        drawn[s] = _hypergeometric(rng, int(m), rest, n)
        n -= int(drawn[s])
    return drawn


def _hypergeometric(rng, good: int, bad: int, n: int) -> int:
    """Draws of ``n`` from ``good`` + ``bad`` that are good, for any size:
    populations too large for numpy's sampler are inverted from the mode."""
    if good == 0 or n == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    # inversion from the mode, in logarithms
    from math import exp, lgamma

    def log_choose(a, b):
        return lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)

    lo, hi = max(0, n - bad), min(good, n)
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (good + bad + 2)))
    p0 = exp(log_choose(good, mode) + log_choose(bad, n - mode) - log_choose(good + bad, n))
    u = rng.random() - p0
    up, down, p_up, p_down = mode, mode, p0, p0
    while u > 0 and (up < hi or down > lo):
        if up < hi:
            p_up *= (good - up) / (up + 1) * (n - up) / (bad - n + up + 1)
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > lo:
            p_down *= down / (good - down + 1) * (bad - n + down) / (n - down + 1)
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def shuffle_to_shards(df: DataFrame, id_col: str = "doc_id", shards: int = SHARDS, seed: int = SEED,
                      block_rows: int = BLOCK_ROWS, least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """``df`` with ``shard`` (0-based; sizes at most one apart) and ``slot``
    (0-based, gapless within the shard). Columns of these names are replaced."""
    spark = prepare(df.sparkSession)
    keep = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    total = df.count()
    blocks = max(least_blocks, -(-total // block_rows))
    rank = F.xxhash64(F.col(id_col), F.lit(seed))
    # repeated ids are told apart by their place in a tie-break hash of the row
    tie = F.xxhash64(*[F.col(c) for c in keep], F.lit(seed + 1))
    rows = df.select(*[F.col(c) for c in keep], rank.alias("_rank"), tie.alias("_tie"))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_rank", "_tie", F.lit(seed + 2)), F.lit(blocks)).cast("int"))
    counts = {r[0]: r[1] for r in rows.groupBy("_block").count().collect()}  # one row per block
    matrix = communication_matrix([counts.get(b, 0) for b in range(blocks)], shards, seed)
    ends = spark.createDataFrame([(b, row) for b, row in enumerate(matrix.cumsum(axis=1).tolist())],
                                 "_block int, _ends array<long>")

    first = Window.partitionBy("_block").orderBy("_rank", "_tie")
    sent = (rows.withColumn("_at", F.row_number().over(first) - 1).join(ends, "_block")
            .withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_at"))).cast("int")))
    # second permutation: order by another hash, cut by its leading bits into pieces
    pieces = max(1, -(-blocks // shards))
    sent = (sent.withColumn("_order", F.xxhash64("_rank", "_tie", F.lit(seed + 3)))
            .withColumn("_piece", F.floor(F.shiftrightunsigned("_order", 1) / F.lit(2.0 ** 63) * pieces).cast("int"))
            .drop("_ends", "_at", "_block"))
    sent = materialize(sent)
    sizes = sent.groupBy("shard", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("shard", "_piece", (F.sum("_n").over(
        Window.partitionBy("shard").orderBy("_piece")) - F.col("_n")).alias("_off"))
    place = F.row_number().over(Window.partitionBy("shard", "_piece").orderBy("_order", "_rank", "_tie"))
    return (sent.withColumn("_at", place - 1).join(offsets, ["shard", "_piece"])
            .select(*keep, "shard", (F.col("_off") + F.col("_at")).cast("long").alias("slot")))


def op7_shards(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    light = docs.select("doc_id", (F.octet_length(body) + 16).cast("long").alias("size"),
                        F.crc32(body).cast("long").alias("text_crc32"))
    # grown_shard belongs to the key law alone
    return shuffle_to_shards(light).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                                           F.lit(None).cast("int").alias("grown_shard"))
