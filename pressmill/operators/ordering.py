"""Skew-safe global order: positions and predecessors without one-task windows.

A window ``PARTITION BY key ORDER BY ts`` puts every row of a key in one
task, and a global ``row_number()`` puts every row in one task. Here:

1. rows are range-partitioned on the full ordering (a hot key is split
   across several range partitions because the bounds include ``ts`` and a
   unique tiebreak), sorted within partitions and checkpointed, so the
   partition boundaries stay fixed on recomputation or task retry;
2. ``monotonically_increasing_id`` on the checkpoint encodes
   (partition << 33 | row-in-partition);
3. per-partition row counts (one row per partition) give prefix offsets, so
   every row gets its exact global position; the predecessor of a row is
   found by an equi-join on the (unique) position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressmill.session import materialize

_ROW_BITS = 33


def _sorted_with_slots(df: DataFrame, order: list[Column], n_parts: int | None) -> DataFrame:
    spark = df.sparkSession
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    s = materialize(s)
    m = F.monotonically_increasing_id()
    return (s.withColumn("_m", m)
            .withColumn("_pid", F.shiftright(F.col("_m"), _ROW_BITS))
            .withColumn("_r", F.col("_m").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))))


def global_index(df: DataFrame, order: list[Column], out: str = "position",
                 n_parts: int | None = None) -> DataFrame:
    """Adds ``out``: 0-based position of each row in the total order ``order``
    (which must be a total order, e.g. end with a unique id)."""
    s = _sorted_with_slots(df, order, n_parts)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: the prefix sum runs on a tiny table
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    return (s.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_off") + F.col("_r"))
            .drop("_m", "_pid", "_r", "_off"))


def keyed_lag(df: DataFrame, key: str, order: list[Column], carry: list[str],
              prefix: str = "prev_", n_parts: int | None = None) -> DataFrame:
    """For every row, the ``carry`` columns of the previous row of the same
    ``key`` in ``order`` (NULL for a key's first row) as ``prefix + col``.

    ``order`` must start with ``key`` and end with a unique tiebreak."""
    s = _sorted_with_slots(df, order, n_parts)
    last = s.groupBy("_pid").agg(F.max("_r").alias("_last_r"))
    # predecessor slot: previous row in the partition, or the last row of the
    # previous partition for a partition's first row
    prev_last = last.select((F.col("_pid") + 1).alias("_pid"), "_last_r")
    s = s.join(F.broadcast(prev_last), "_pid", "left")
    prev_m = F.when(F.col("_r") > 0, F.col("_m") - 1).when(
        F.col("_last_r").isNotNull(),
        F.shiftleft(F.col("_pid") - 1, _ROW_BITS) + F.col("_last_r"))
    s = s.withColumn("_prev_m", prev_m)
    prev = s.select(F.col("_m").alias("_prev_m"), F.col(key).alias("_prev_key"),
                    *[F.col(c).alias(prefix + c) for c in carry])
    j = s.join(prev, "_prev_m", "left")
    same = F.col("_prev_key").eqNullSafe(F.col(key))
    for c in carry:
        j = j.withColumn(prefix + c, F.when(same, F.col(prefix + c)))
    return j.drop("_m", "_pid", "_r", "_last_r", "_prev_m", "_prev_key")
