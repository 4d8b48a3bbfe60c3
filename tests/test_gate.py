"""The distributed due gate equals a plain replay."""

import random
from datetime import datetime, timedelta

import numpy as np

from pressmill.operators import gate


def replay(rows, last=None):
    last, out = dict(last or {}), {}
    for search, tick, ts, period in sorted(rows, key=lambda r: (r[2] is None, r[2] or datetime.min, r[1])):
        if search is None or ts is None:
            out[tick] = False
            continue
        before = last.get(search)
        out[tick] = before is None or (ts - before) > timedelta(microseconds=gate.period_micros(period))
        if out[tick]:
            last[search] = ts
    return out


def test_staircase_tells_where_any_start_ends():
    rng = random.Random(6)
    for _ in range(300):
        times = np.array(sorted(rng.randint(0, 60) for _ in range(rng.randint(1, 25))))
        period = rng.randint(0, 30)
        steps = gate.staircase(times, period)
        assert [s[0] for s in steps] == sorted({s[0] for s in steps})
        for start in [gate.NEVER, *range(-40, 70)]:
            want = gate.decide(times.tolist(), period, start)[1]
            got = next((last for below, last in steps if start < below), start)
            assert got == want, (times, period, start)


def test_due_ticks_with_a_hot_search_in_many_partitions(spark):
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    periods = {1: "hourly", 2: "daily", 3: "weekly", 4: None, 5: "hourly"}
    rows = []
    for tick in range(4_000):
        search = 1 if tick % 3 else rng.choice([2, 3, 4, 5, None])
        ts = start + timedelta(seconds=rng.randint(0, 20 * 86400) // 60 * 60) if rng.random() < 0.99 else None
        rows.append((search, tick, ts, periods.get(search)))
    rng.shuffle(rows)
    schema = "search_pk long, tick_id long, tick_ts timestamp, period string"
    df = spark.createDataFrame(rows, schema).repartition(5)
    for last in ({}, {1: start + timedelta(days=3), 3: start + timedelta(days=1)}):
        state = spark.createDataFrame(list(last.items()), "search_pk long, last_due timestamp") if last else None
        got = {r.tick_id: r.due for r in gate.due_ticks(df, state).collect()}
        assert got == replay(rows, last)
    assert gate.due_ticks(df.limit(0)).collect() == []
