"""Streams equal their batch forms on the same rows."""

from datetime import timedelta

import __spark_entry__ as E
from tests.conftest import SF_SMALL

PERIOD = {"hourly": timedelta(hours=1), "daily": timedelta(days=1), "weekly": timedelta(days=7)}


def test_due_gate_matches_replay(spark):
    got = {r["tick_id"]: r["due"] for r in E.queries()["stream_due"](spark, SF_SMALL).collect()}
    ticks = (spark.read.parquet(f"{SF_SMALL}/events.parquet").select("user_id", "event_id", "ts").collect())
    periods = {r["id"]: r["period"] for r in E.queries()["search_detail"].__globals__["derive"]
               .searches(spark, SF_SMALL).select("id", "period").collect()}
    want, last = {}, {}
    for r in sorted(ticks, key=lambda r: (r["user_id"], r["ts"], r["event_id"])):
        p = PERIOD.get(periods.get(r["user_id"]), timedelta(days=30))
        prev = last.get(r["user_id"])
        due = prev is None or r["ts"] - prev > p
        if due:
            last[r["user_id"]] = r["ts"]
        want[r["event_id"]] = due
    assert got == want


def test_stream_url_dedup_equals_batch(spark):
    from pyspark.sql import functions as F
    got = sorted(r[0] for r in E.queries()["stream_url_dedup"](spark, SF_SMALL).collect())
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    cands = ev.select(F.concat(F.lit("https://news.example.org/item/"), F.get_json_object("props", "$.k")).alias("u"))
    store = {r[0] for r in E.queries()["search_detail"].__globals__["derive"].searches(spark, SF_SMALL)
             .filter("article_url IS NOT NULL").select("article_url").collect()}
    want = sorted({r[0] for r in cands.collect()} - store)
    assert got == want


def part_files(spark, tmp_path, *names):
    """The small tables, the named ones as four part files whose rows are dealt at random."""
    import os
    import shutil
    from pyspark.sql import functions as F
    for f in os.listdir(SF_SMALL):
        if f.removesuffix(".parquet") not in names:
            shutil.copy(f"{SF_SMALL}/{f}", tmp_path / f)
    for name in names:
        (spark.read.parquet(f"{SF_SMALL}/{name}.parquet").repartition(4, F.rand(seed=8))
         .write.parquet(str(tmp_path / f"{name}.parquet")))
    return str(tmp_path)


def test_streams_do_not_depend_on_the_order_of_files(spark, tmp_path):
    parts_dir = part_files(spark, tmp_path, "events", "documents")
    for name in ("stream_url_dedup", "stream_email_links", "stream_quota_windows", "stream_due", "stream_enrich"):
        whole = sorted(map(str, E.queries()[name](spark, SF_SMALL).collect()))
        parts = sorted(map(str, E.queries()[name](spark, parts_dir).collect()))
        assert parts == whole and whole, name


def test_quota_windows_count_late_rows_and_keep_open_windows(spark, tmp_path):
    from pyspark.sql import functions as F
    from pressmill.streaming import jobs
    schema = "ts timestamp, user_id long, value double"
    for n, rows in enumerate(([("2024-01-01 10:00:30", 1, 1.0), ("2024-01-01 11:00:00", 1, 21.0)],
                              [("2024-01-01 10:00:50", 1, 2.0), ("2024-01-01 10:59:59", 1, 3.0)])):
        df = spark.createDataFrame(rows, "ts string, user_id long, value double").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        if n == 0:
            run = dict(run_id=f"late-{tmp_path.name}")
            jobs.quota_windows(spark, jobs.read_stream(spark, str(tmp_path), "events", schema), **run)
    got = jobs.quota_windows(spark, jobs.read_stream(spark, str(tmp_path), "events", schema), **run)  # resumed
    rows = {str(r.window_start)[11:16]: (r.volume, r.calls, r.over_limit, r.late_calls, r.final) for r in got.collect()}
    assert rows == {"10:00": (300, 2, False, 1, True), "10:58": (300, 1, False, 0, False), "11:00": (2100, 1, True, 0, False)}


def test_due_gate_holds_ticks_until_the_watermark_and_hands_out_late_ones(spark, tmp_path):
    from pyspark.sql import functions as F
    from pressmill.streaming import jobs
    schema = "search_pk long, tick_id long, tick_ts timestamp, period string"

    def arrive(*ticks):
        df = spark.createDataFrame([(1, i, f"2024-01-01 {t}", "hourly") for i, t in ticks],
                                   "search_pk long, tick_id long, tick_ts string, period string")
        (df.withColumn("tick_ts", F.col("tick_ts").cast("timestamp")).coalesce(1)
         .write.mode("append").parquet(str(tmp_path / "ticks.parquet")))

    def run():
        stream = jobs.read_stream(spark, str(tmp_path), "ticks", schema)
        got = jobs.due_gate(spark, stream, delay="2 hours", run_id=f"late-{tmp_path.name}").collect()
        return {r.tick_id: (r.due, r.late) for r in got}

    arrive((1, "01:00:00"), (3, "03:30:00"))
    run_one = run()
    assert run_one == {1: (True, False), 3: (True, False)}  # the end of a drained run releases all
    arrive((2, "02:00:00"), (4, "04:00:00"), (5, "04:31:00"))
    assert run() == {1: (True, False), 2: (None, True), 3: (True, False), 4: (False, False), 5: (True, False)}


def test_seen_urls_open_only_the_buckets_they_hit(spark, tmp_path):
    from pressmill.streaming.seen import SeenUrls
    seen = SeenUrls(spark, str(tmp_path / "seen"), blocks=64, buckets=16)

    def urls(values):
        return spark.createDataFrame([(v,) for v in values], "url string")
    seen.add(0, urls([f"https://a/{i}" for i in range(300)]))
    seen.add(1, urls(["https://late/1", None]))
    met, opened = seen.met(2, urls(["https://late/1", "https://a/7", "https://new/1", "https://new/2"]))
    assert sorted(r.url for r in met.collect()) == ["https://a/7", "https://late/1"]
    assert 1 <= len(opened) <= 4
    met, opened = seen.met(1, urls(["https://late/1"]))  # a replayed epoch does not see itself
    assert met.collect() == []


def test_candidates_are_known_by_either_url(spark, tmp_path):
    from pyspark.sql import functions as F
    from pressmill.streaming import jobs
    schema = "ts timestamp, article_url string, final_url string"
    store = spark.createDataFrame([("https://s/1",)], "article_url string")
    rows = [[("10:00", "https://s/1", "https://x/1"), ("10:01", "https://r/1", "https://s/1"), ("10:02", "https://r/2", "https://f/2"),
             ("10:03", "https://r/3", "https://f/2"), ("10:04", "https://r/4", None), ("10:05", None, None)],
            [("09:00", "https://f/2", None), ("09:30", "https://r/9", "https://f/9"), ("10:09", "https://r/4", "https://z/4")]]
    sink = None
    for part in rows:
        df = spark.createDataFrame([(f"2024-01-01 {t}:00", a, f) for t, a, f in part], "ts string, article_url string, final_url string")
        (df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "c.parquet")))
        stream = jobs.read_stream(spark, str(tmp_path), "c", schema)
        sink = jobs.url_dedup(spark, stream, store, run_id=f"keys-{tmp_path.name}")
    assert sorted(r.article_url for r in sink.collect()) == ["https://r/2", "https://r/4", "https://r/9"]


def test_epoch_tables_fold_into_bases_and_survive_replay(spark, tmp_path):
    from pyspark.sql import functions as F
    from pressmill.streaming.epochs import EpochTable
    t = EpochTable(spark, str(tmp_path / "t"), lambda df: df.groupBy("k").agg(F.sum("n").alias("n")), every=3)

    def rows(n):
        return spark.createDataFrame([("a", n), (f"b{n}", 1)], "k string, n long")
    assert t.last() == -1 and t.now() is None and t.before(5) is None
    for e in range(7):
        t.write(e, rows(e))
    t.write(5, rows(5))  # replayed, with the base that it completes
    assert {r.k: r.n for r in t.now().collect()} == {"a": 21, **{f"b{e}": 1 for e in range(7)}}
    assert {r.k: r.n for r in t.before(4).collect()} == {"a": 6, **{f"b{e}": 1 for e in range(4)}}
    assert sum("base" in p for p in t._parts(7)) == 1 and len(t._parts(7)) == 2


def test_export_numbers_batches_across_micro_batches(spark, tmp_path):
    from pressmill.plans import derive
    from pressmill.streaming import jobs
    arts = derive.articles(spark, SF_SMALL).selectExpr("*", "title AS translated_title", "body AS translated_body")
    path = str(tmp_path / "articles.parquet")
    arts.repartition(3, "id").write.parquet(path)
    stream = jobs.read_stream(spark, str(tmp_path), "articles", arts.schema)
    searches = derive.searches(spark, SF_SMALL)
    ledger = jobs.export(spark, stream, searches, run_id=f"test-{tmp_path.name}").collect()
    ids = [r["article_id"] for r in ledger]
    assert len(ids) == len(set(ids))
    epochs = {}
    for r in ledger:
        epochs.setdefault(r["batch_id"], set()).add(r["epoch"])
    assert all(len(e) == 1 for e in epochs.values())
