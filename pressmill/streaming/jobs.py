"""Structured Streaming jobs (M1-M8).

The harvested system polls on timers; here the same work runs as streams. What a micro-batch has to
leave for later ones lies in tables kept by epoch (``epochs.py``), in forms that merge, so results do not
depend on how a table is cut into files or in what order they come:

* M1, M6 due gate: ticks held until the watermark passes them, decided in time order;
* M2 export: K1-K4 per micro-batch with the push ledger (M8: a replayed
  micro-batch finds its articles in the ledger and pushes nothing twice);
* M3 enrichment: running document frequencies, scored when read;
* M4 mailbox links: F4 flattening on arriving email searches;
* M5 URL seen-before: a store in buckets behind bitmaps (``seen.py``);
* M7 quota windows: partial sums per window and micro-batch.

Every job keeps its checkpoint and sink under the shared checkpoint folder,
so a restarted driver or lost executor resumes from the last committed
micro-batch. ``trigger`` defaults to ``availableNow`` (drain and stop); pass
``processingTime='5 minutes'`` (M1) or ``'2 minutes'`` (M2) for the
reference cadence.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.schemas import QUOTA_VOLUME
from pressmill.session import checkpoint_dir
from pressmill.streaming.epochs import EpochTable
from pressmill.streaming.seen import SeenUrls


def stream_paths(spark: SparkSession, name: str, run_id: str | None = None) -> tuple[str, str]:
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}/{run_id or uuid.uuid4().hex}"
    return f"{base}/checkpoint", f"{base}/sink"


def read_stream(spark: SparkSession, sf_dir: str, name: str, schema) -> DataFrame:
    """A shipped table as a file stream, whether it is one file or a folder of
    part files (the pattern matches the name itself, so both are listed)."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]"))


def _has_epochs(spark: SparkSession, path: str) -> bool:
    """Whether a sink holds a finished micro-batch."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch=*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _run(writer, trigger: dict | None):
    t = trigger or {"availableNow": True}
    q = writer.trigger(**t).start()
    if "availableNow" in t or "once" in t:
        q.awaitTermination()
    return q


def candidate_urls(events: DataFrame) -> DataFrame:
    """Candidates of arriving events: ts, article_url (as asked for), final_url (after redirects)."""
    url = F.concat(F.lit("https://news.example.org/item/"), F.get_json_object("props", "$.k"))
    return events.select(F.col("ts").cast("timestamp").alias("ts"), url.alias("article_url"), url.alias("final_url"))


def url_dedup(spark: SparkSession, candidates: DataFrame, store_urls: DataFrame, name: str = "url_dedup",
              trigger: dict | None = None, run_id: str | None = None) -> DataFrame:
    """M5 + F11: candidate URLs (ts, article_url, final_url), once each. A candidate is known if its requested or its
    final URL is stored or came out earlier. There is no watermark, so a late row is a row like any other:
    the store of seen URLs answers for any time past. Returns the sink: article_url, final_url, epoch."""
    ckpt, base = stream_paths(spark, name, run_id)
    sink, seen = f"{base}/new", SeenUrls(spark, f"{base}/seen")
    if seen.store.last() < 0:  # a resumed stream has it
        seen.add(0, store_urls.select(F.col("article_url").alias("url")).distinct())

    def push(batch: DataFrame, epoch: int):
        rows = batch.where("article_url IS NOT NULL").select(
            "article_url", F.coalesce("final_url", "article_url").alias("final_url"), "ts")
        for key in ("article_url", "final_url"):  # the earliest of each, by either key
            first = F.min(F.struct("ts", "article_url", "final_url")).alias("r")
            rows = rows.groupBy(F.col(key).alias("k")).agg(first).select("r.*")
        urls = rows.select(F.explode(F.array("article_url", "final_url")).alias("url")).distinct()
        met, _ = seen.met(epoch + 1, urls)
        if met is not None:
            for key in ("article_url", "final_url"):
                rows = rows.join(met.select(F.col("url").alias(key)), key, "left_anti")
        rows.select("article_url", "final_url").write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")
        new = spark.read.parquet(f"{sink}/epoch={epoch}")
        seen.add(epoch + 1, new.select(F.explode(F.array("article_url", "final_url")).alias("url")).distinct())

    _run(candidates.writeStream.foreachBatch(push).option("checkpointLocation", ckpt), trigger)
    return spark.read.parquet(sink)


def quota_windows(spark: SparkSession, events: DataFrame, name: str = "quota_windows",
                  window: str = "2 minutes", delay: str = "10 minutes", trigger: dict | None = None,
                  run_id: str | None = None) -> DataFrame:
    """M7: characters per caller per tumbling event-time window; windows over the volume limit are flagged.

    A micro-batch leaves one partial sum per window and caller. Partial sums add up, so the windows hold all rows in
    whatever order they came: a late row adds to its window and is counted in ``late_calls``, an open window
    is there with ``final`` false. A window is final once the watermark (newest event time - delay) has passed its end;
    a row is late if it came in a later micro-batch than that."""
    ckpt, base = stream_paths(spark, name, run_id)
    sums = EpochTable(spark, f"{base}/sums", lambda df: df.groupBy("window_start", "window_end", "user_id").agg(
        F.sum("volume").alias("volume"), F.sum("calls").alias("calls"), F.sum("late_calls").alias("late_calls")))
    marks = EpochTable(spark, f"{base}/marks", lambda df: df.agg(F.max("newest").alias("newest")))

    def mark(df):
        return None if df is None else df.first()["newest"]

    def push(batch: DataFrame, epoch: int):
        rows = batch.select(F.col("ts").cast("timestamp").alias("ts"), "user_id",
                            F.floor(F.col("value") * 100).cast("bigint").alias("volume"))
        part = (rows.groupBy(F.window("ts", window).alias("w"), "user_id")
                .agg(F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("calls"), F.max("ts").alias("newest")))
        before = mark(marks.before(epoch))
        late = F.lit(False) if before is None else F.col("w.end") <= F.lit(before) - F.expr(f"INTERVAL {delay}")
        part = part.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "user_id", "volume",
                           "calls", F.when(late, F.col("calls")).otherwise(0).alias("late_calls"), "newest")
        sums.write(epoch, part)
        marks.write(epoch, sums.delta(epoch).agg(F.max("newest").alias("newest")))

    _run(events.writeStream.foreachBatch(push).option("checkpointLocation", ckpt), trigger)
    newest = mark(marks.now())
    return sums.now().select("window_start", "user_id", "volume", "calls", (F.col("volume") > QUOTA_VOLUME).alias("over_limit"),
                             "late_calls", (F.col("window_end") <= F.lit(newest) - F.expr(f"INTERVAL {delay}")).alias("final"))


def email_links(spark: SparkSession, email_rows: DataFrame, name: str = "email_links",
                trigger: dict | None = None, run_id: str | None = None) -> DataFrame:
    """M4: links of arriving email searches are queued at once (period ignored);
    a NULL mailbox yields no rows."""
    from pressmill.operators.frontier import email_link_rows
    ckpt, sink = stream_paths(spark, name, run_id)
    out = email_rows.select("message_id", "search_pk",
                            F.explode(email_link_rows(F.col("email_links"))).alias("target"))
    _run(out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt), trigger)
    return spark.read.parquet(sink)


def enrich(spark: SparkSession, articles: DataFrame, gazetteer: DataFrame,
           name: str = "enrich", k: int = 10, trigger: dict | None = None, run_id: str | None = None) -> DataFrame:
    """M3: the enrichment gate as a stream filter. A micro-batch leaves its articles' term counts and places, and adds
    its document count and document frequencies to a running table. Scores are formed when the records are
    read, against the frequencies of everything that has come by then, so they do not
    depend on how the articles were dealt to micro-batches. Returns the records: id, keywords (the ``k`` best terms),
    locations, n_locations, processed."""
    from pressmill.operators import enrich as en
    ckpt, base = stream_paths(spark, name, run_id)
    # the empty term, which no text has, counts the documents
    freqs = EpochTable(spark, f"{base}/frequencies", lambda df: df.groupBy("term").agg(F.sum("df").alias("df")))
    gated = en.enrichment_gate(articles)

    def process(batch: DataFrame, epoch: int):
        b = batch.select("id", "body", F.col("translated_body").isNotNull().alias("processed"))
        en.terms(b, "id", "body").write.mode("overwrite").parquet(f"{base}/terms/epoch={epoch}")
        b.select("id", "processed").write.mode("overwrite").parquet(f"{base}/articles/epoch={epoch}")
        en.locations(b, gazetteer, "id", "body").write.mode("overwrite").parquet(f"{base}/places/epoch={epoch}")
        term_rows, art_rows = (spark.read.parquet(f"{base}/{t}/epoch={epoch}") for t in ("terms", "articles"))
        freqs.write(epoch, term_rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")).unionByName(
            art_rows.agg(F.count(F.lit(1)).alias("df")).withColumn("term", F.lit(""))))

    _run(gated.writeStream.foreachBatch(process).option("checkpointLocation", ckpt), trigger)
    arts, terms, places = (spark.read.parquet(f"{base}/{t}").drop("epoch") for t in ("articles", "terms", "places"))
    known = freqs.now()
    kw = en.score_terms(terms, known.where("term <> ''"), known.where("term = ''").select(F.col("df").alias("n")), "id", k)
    return en.records(arts, kw, places, "id")


def export(spark: SparkSession, articles: DataFrame, searches: DataFrame, name: str = "export",
           pushed_at: str = "2024-01-31 00:00:00", trigger: dict | None = None,
           run_id: str | None = None) -> DataFrame:
    """M2 + K1-K4 + M8: each micro-batch selects exportable articles, drops
    those already in the ledger, numbers batches of 50, writes the payloads
    and appends the ledger. Returns the ledger."""
    from pressmill.operators import export as ex
    ckpt, base = stream_paths(spark, name, run_id)
    sink, ledger = f"{base}/payloads", f"{base}/ledger"

    def process(batch: DataFrame, epoch: int):
        sel = ex.export_selection(batch, searches)
        first = 0
        if _has_epochs(spark, ledger):  # articles pushed by earlier micro-batches
            pushed = spark.read.parquet(ledger).filter(F.col("epoch") < epoch)
            sel = ex.unpushed(sel, pushed)
            last = pushed.agg(F.max("batch_id")).first()[0]
            first = 0 if last is None else int(last) + 1
        # batch numbers go on from one micro-batch to the next
        b = ex.batches(sel).withColumn("batch_id", F.col("batch_id") + F.lit(first))
        # payload and ledger partitions of this epoch are overwritten on replay
        ex.push(ex.payload(b), f"{sink}/epoch={epoch}", f"{ledger}/epoch={epoch}", pushed_at)

    _run(articles.writeStream.foreachBatch(process).option("checkpointLocation", ckpt), trigger)
    return spark.read.parquet(ledger)


def due_gate(spark: SparkSession, ticks: DataFrame, name: str = "due_gate", delay: str | None = None,
             trigger: dict | None = None, run_id: str | None = None) -> DataFrame:
    """M1 + M6: scheduler ticks ``(search_pk, tick_id, tick_ts, period)`` in time order, whatever order they come in.

    Ticks are held until the watermark (newest tick - ``delay``) has passed them; a micro-batch then
    decides all that it releases, from its searches' last due times. A tick behind what was released
    already cannot be put in order any more: it comes out with ``late`` and without a decision. When an
    ``availableNow`` run has drained its source, the ticks still held are released. Without a ``delay`` ticks are
    held until then, which orders any table; a continuous run has to name one.
    Returns search_pk, tick_id, tick_ts, due, late."""
    from pressmill.operators.gate import due_ticks
    drains = trigger is None or "availableNow" in trigger or "once" in trigger
    if delay is None and not drains:
        raise ValueError("a continuous run needs a delay")
    ckpt, base = stream_paths(spark, name, run_id)
    held, sink = EpochTable(spark, f"{base}/held", every=1 << 30), f"{base}/decided"
    # what a micro-batch leaves has slot 2 * epoch, what the end of a drained run adds the odd one behind it
    last = EpochTable(spark, f"{base}/last", lambda df: df.groupBy("search_pk").agg(F.max("last_due").alias("last_due")))
    marks = EpochTable(spark, f"{base}/marks", lambda df: df.agg(F.max("newest").alias("newest"), F.max("released").alias("released")))

    def mark(slot):
        got = marks.before(slot)
        row = None if got is None else got.first()
        return (None, None) if row is None else (row["newest"], row["released"])

    def release(slot: int, after, upto, late):
        rows = spark.read.parquet(f"{base}/held/delta").drop("epoch")
        ready = rows.where(F.col("tick_ts") <= F.lit(upto)) if after is None else rows.where(
            (F.col("tick_ts") > F.lit(after)) & (F.col("tick_ts") <= F.lit(upto)))
        decided = due_ticks(ready, last.before(slot)).withColumn("late", F.lit(False))
        if late is not None:
            decided = decided.unionByName(late.select("search_pk", "tick_id", "tick_ts", F.lit(None).cast("boolean").alias("due"),
                                                      F.lit(True).alias("late")))
        decided.write.mode("overwrite").parquet(f"{sink}/slot={slot}")
        done = spark.read.parquet(f"{sink}/slot={slot}")
        last.write(slot, done.where("due").groupBy("search_pk").agg(F.max("tick_ts").alias("last_due")))

    def push(batch: DataFrame, epoch: int):
        newest, released = mark(2 * epoch)
        held.write(epoch, batch.select("search_pk", "tick_id", "tick_ts", "period"))
        rows = held.delta(epoch)
        here = rows.agg(F.max("tick_ts")).first()[0]
        newest = here if newest is None else newest if here is None else max(newest, here)
        no_time = rows.where("tick_ts IS NULL OR search_pk IS NULL")  # never due, nothing to wait for
        if delay is None or newest is None:
            upto = released
        else:
            upto = spark.range(1).select(F.lit(newest) - F.expr(f"INTERVAL {delay}")).first()[0]
            upto = upto if released is None else max(upto, released)
        late = rows.where(F.col("tick_ts") <= F.lit(released)) if released is not None else None
        if upto is not None:
            release(2 * epoch, released, upto, late)
        untimed = no_time.select("search_pk", "tick_id", "tick_ts", F.lit(False).alias("due"), F.lit(False).alias("late"))
        untimed.write.mode("overwrite").parquet(f"{base}/untimed/epoch={epoch}")
        marks.write(2 * epoch, spark.createDataFrame([(newest, upto)], "newest timestamp, released timestamp"))

    _run(ticks.writeStream.foreachBatch(push).option("checkpointLocation", ckpt), trigger)
    if drains and held.last() >= 0:
        slot = 2 * held.last() + 1
        newest, released = mark(slot)
        if newest is not None and (released is None or released < newest):
            release(slot, released, newest, None)
            marks.write(slot, spark.createDataFrame([(newest, newest)], "newest timestamp, released timestamp"))
    untimed = spark.read.parquet(f"{base}/untimed").drop("epoch")
    return spark.read.parquet(sink).drop("slot").unionByName(untimed) if marks.now().first()["released"] else untimed
