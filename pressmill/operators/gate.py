"""The due gate over any number of ticks, in time order (M1, M6).

A tick is due when its search never ran, or when the search's period has strictly passed since its last due tick. That
is a chain: every decision needs the one before. Ticks are range-partitioned by (search, time), so a
search with a third of all ticks lies in many partitions, and the chain is cut there:

1. a partition's part of a search is a function of the last due time before it. A later start
   never ends earlier, so the function is a staircase: one row per end that some start leads to;
2. per search that lies in several partitions, the staircases are applied in order; this gives
   each partition the time to start from (one row per partition);
3. every partition decides its ticks from there, in one pass that holds one time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.session import materialize

_PERIOD_SECONDS = {"hourly": 3600, "daily": 86400, "weekly": 7 * 86400}
#: Stands for "never ran": before any tick.
NEVER = -(1 << 62)


def period_micros(period) -> int:
    """hourly / daily / weekly; anything else is 30 days."""
    return _PERIOD_SECONDS.get(period, 30 * 86400) * 1_000_000


def staircase(times: np.ndarray, period: int) -> list[tuple[int, int]]:
    """(below, last): a start before ``below`` (and not before the ``below`` above it in the list) ends at
    ``last``. A start at or after the final ``below`` makes no tick due."""
    n = len(times)
    follows = np.searchsorted(times, times + period, side="right").tolist()
    end = list(range(n))
    for i in range(n - 1, -1, -1):
        if follows[i] < n:
            end[i] = end[follows[i]]
    steps: list[tuple[int, int]] = []
    for below, last in zip((times - period).tolist(), times[end].tolist()):
        if steps and (steps[-1][1] == last or steps[-1][0] == below):
            steps[-1] = (below, steps[-1][1])
        else:
            steps.append((below, last))
    return steps


def decide(times: list[int], period: int, last: int) -> tuple[list[bool], int]:
    due = []
    for t in times:
        hit = t - last > period
        if hit:
            last = t
        due.append(hit)
    return due, last


def _segments(batches):
    """(search, period, times, rows) of each run of one search in one range partition, in sorted batches; a run may
    come in several pieces."""
    for b in batches:
        keys = list(zip(b.column("search_pk").to_pylist(), b.column("pid").to_pylist()))
        times = b.column("at").to_numpy(zero_copy_only=False)
        begin = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[begin]:
                yield keys[begin][0], b.column("period")[begin].as_py(), times[begin:i], b.slice(begin, i - begin)
                begin = i


def due_ticks(ticks: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """``ticks`` (search_pk, tick_id, tick_ts, period) with ``due``, given the searches' last due times (search_pk,
    last_due). A tick without a time or a search is never due. The period is the search's, the same on all its ticks."""
    spark = ticks.sparkSession
    known = F.col("search_pk").isNotNull() & F.col("tick_ts").isNotNull()
    rows = ticks.where(known).select(F.col("search_pk").cast("long").alias("search_pk"), F.col("tick_id").cast("long").alias("tick_id"),
                                     "tick_ts", F.unix_micros("tick_ts").alias("at"), "period")
    order = ["search_pk", "at", "tick_id"]
    cut = materialize(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
                      .sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()))

    def stairs(batches):
        # only a partition's first and last search may go on beside it
        parts, pid = [], None
        for key, period, times, rows in _segments(batches):
            pid = rows.column("pid")[0].as_py()
            if parts and parts[-1][0] == key:
                parts[-1][2].append(times)
            else:
                if len(parts) > 1:
                    parts.pop()
                parts.append((key, period, [times]))
        out = [(key, pid, below, end) for key, period, times in parts
               for below, end in staircase(np.concatenate(times), period_micros(period))]
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["search_pk", "pid", "below", "last"])

    steps = cut.select("search_pk", "at", "tick_id", "period", "pid").mapInArrow(stairs, "search_pk long, pid long, below long, last long")
    several = materialize(steps)
    many = several.groupBy("search_pk").agg(F.count_distinct("pid").alias("n")).where("n > 1").select("search_pk")
    before = several.join(many, "search_pk", "left_semi")
    if last is not None:
        before = before.join(last.select("search_pk", F.unix_micros("last_due").alias("ran")), "search_pk", "left")
    else:
        before = before.withColumn("ran", F.lit(None).cast("long"))

    def follow(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pid", "ascending"), ("below", "ascending")])
        ran = table.column("ran")[0].as_py()
        at, out = NEVER if ran is None else ran, []
        pids = table.column("pid").to_numpy()
        below, ends = table.column("below").to_numpy(), table.column("last").to_numpy()
        starts = np.flatnonzero(np.r_[True, pids[1:] != pids[:-1]])
        for lo, hi in zip(starts, np.r_[starts[1:], len(pids)]):
            out.append((table.column("search_pk")[0].as_py(), int(pids[lo]), at))
            k = int(np.searchsorted(below[lo:hi], at, side="right"))
            at = int(ends[lo + k]) if lo + k < hi else at
        cols = list(zip(*out))
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("search_pk", "pid", "start"), cols)})

    # at most two searches per partition reach beyond it: that many rows come to the driver
    starts = {(r.search_pk, r.pid): r.start for r in
              before.groupBy("search_pk").applyInArrow(follow, "search_pk long, pid long, start long").collect()}

    def run(batches):
        key = at = None
        for b in batches:
            for search, period, times, part in _segments([b]):
                here = (search, part.column("pid")[0].as_py())
                if here != key:
                    ran = part.column("ran")[0].as_py()
                    key, at = here, starts.get(here, NEVER if ran is None else ran)
                due, at = decide(times.tolist(), period_micros(period), at)
                yield pa.RecordBatch.from_arrays([part.column("search_pk"), part.column("tick_id"), part.column("tick_ts"),
                                                  pa.array(due, pa.bool_())], names=["search_pk", "tick_id", "tick_ts", "due"])

    held = cut.withColumn("ran", F.lit(None).cast("long"))
    if last is not None:
        # the searches' last runs meet the ticks where they lie: the sort order is restored within the same range partitions
        held = (cut.join(last.select("search_pk", F.unix_micros("last_due").alias("ran")), "search_pk", "left")
                .repartition("pid").sortWithinPartitions("pid", *order))
    decided = held.select("search_pk", "tick_id", "tick_ts", "at", "period", "pid", "ran").mapInArrow(
        run, "search_pk long, tick_id long, tick_ts timestamp, due boolean")
    rest = ticks.where(~known).select(F.col("search_pk").cast("long").alias("search_pk"), F.col("tick_id").cast("long").alias("tick_id"),
                                      "tick_ts", F.lit(False).alias("due"))
    return decided.unionByName(rest)
