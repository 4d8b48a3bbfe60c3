"""Export, lookups and store maintenance.

Batches of 50 are numbered from exact global positions (``ordering``), not
from a one-task ``row_number``. Pushing is idempotent: every pushed article
is recorded in a ledger ``pushed_log(article_id, batch_id, pushed_at)`` and
the next run anti-joins it, so a replayed micro-batch or retried task never
pushes an article twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.functions import urls as ux
from pressmill.operators.ordering import global_index, keyed_lag
from pressmill.schemas import (EXPORT_BATCH, EXPORT_SINCE, QUOTA_VOLUME, QUOTA_WINDOW_SECONDS, SEARCH_TYPES,
                               SEARCH_TYPE_LABELS, SOURCE_LABELS, SOURCES)


#: Places of an article, as the enrichment record writes them.
LOCATIONS = "coordinates array<struct<name string, type string>>"


def export_selection(articles: DataFrame, searches: DataFrame) -> DataFrame:
    """K1 (+J1): translated, processed, not pushed, crawled since the cut-off,
    and attached to a search that has a search_id."""
    s = searches.select(F.col("id").alias("_sid"), "search_id")
    a = articles.filter(F.col("translated") & F.col("processed") & ~F.col("pushed") &
                        (F.col("post_date_crawled") >= F.lit(EXPORT_SINCE).cast("timestamp")))
    return (a.join(s, a["search_pk"] == s["_sid"], "inner")
            .filter(F.col("search_id").isNotNull()).drop("_sid"))


def newest_first() -> list[Column]:
    """O1: newest crawl first; id breaks ties."""
    return [F.col("post_date_crawled").desc(), F.col("id").asc()]


def batches(selection: DataFrame, size: int = EXPORT_BATCH, max_batches: int | None = None) -> DataFrame:
    """Consecutive slices of ``size`` in newest-first order -> ``batch_id``;
    ``max_batches`` keeps only the first batches of this run."""
    idx = global_index(selection, newest_first())
    out = idx.withColumn("batch_id", F.floor(F.col("position") / size))
    return out.filter(F.col("batch_id") < max_batches) if max_batches is not None else out


def payload(batched: DataFrame, tag_names: DataFrame | None = None, key: str = "id") -> DataFrame:
    """K2: the transfer document per article: 18 named fields, nested tags and locations.

    ``batched`` may lack what enrichment adds (authors, post_date_created, top_image_url, top_image, locations as a
    JSON text); such a field is null. ``tag_names`` is (key, tags)."""
    b = batched
    if tag_names is not None:
        b = b.join(tag_names, key, "left")
    else:
        b = b.withColumn("tags", F.array().cast("array<string>"))
    for name, kind in (("authors", "string"), ("post_date_created", "timestamp"), ("top_image_url", "string"),
                       ("top_image", "string"), ("locations", "string")):
        if name not in b.columns:
            b = b.withColumn(name, F.lit(None).cast(kind))
    stamp = "yyyy-MM-dd HH:mm:ss"
    doc = F.struct(
        "article_url", "source_language", "title", "translated_title", "body", "translated_body", "authors",
        F.date_format("post_date_created", stamp).alias("post_date_created"),
        F.date_format("post_date_crawled", stamp).alias("post_date_crawled"),
        "translated", "top_image_url", "top_image", "processed", "search_id", "channel", "status",
        F.from_json("locations", LOCATIONS).alias("locations"),
        F.transform(F.coalesce("tags", F.array().cast("array<string>")),
                    lambda t: F.struct(t.alias("name"))).alias("tags"),
    )
    return b.select(key, "batch_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("payload"))


def unpushed(selection: DataFrame, ledger: DataFrame, key: str = "id") -> DataFrame:
    """K4: articles whose push is not recorded yet."""
    return selection.join(ledger.select(F.col("article_id").alias(key)), key, "left_anti")


def ledger_rows(batched: DataFrame, pushed_at, key: str = "id") -> DataFrame:
    """K4: ledger rows for a pushed set of batches."""
    return batched.select(F.col(key).alias("article_id"), "batch_id",
                          F.lit(pushed_at).cast("timestamp").alias("pushed_at"))


def push(batched: DataFrame, sink_dir: str, ledger_dir: str, pushed_at, key: str = "id") -> None:
    """K4 sink: write the payloads (``batch_id`` is a column), then the ledger.

    ``sink_dir`` and ``ledger_dir`` belong to this run (e.g. one folder per
    micro-batch epoch): both are overwritten, so a retried run rewrites and
    never duplicates; the ledger is written only after the payload commit."""
    batched.select(key, "batch_id", "payload").write.mode("overwrite").json(sink_dir)
    ledger_rows(batched, pushed_at, key).write.mode("overwrite").parquet(ledger_dir)


def upsert_articles(store: DataFrame, incoming: DataFrame, key: str = "article_url", order: str = "id") -> DataFrame:
    """K5: insert incoming articles whose URL is not stored; a URL arriving
    several times in the batch is inserted once (smallest ``order``).
    Stored rows are never replaced; of stored rows with one URL the smallest
    ``order`` stays, so URLs are unique in the result."""
    from pressmill.operators.dedup import keep_first
    store = keep_first(store, key, order).select(*store.columns)
    fresh = keep_first(incoming.join(store.select(key), key, "left_anti"), key, order)
    return store.unionByName(fresh.select(*store.columns))


def backlog_exists(selection: DataFrame) -> bool:
    """Is there anything to export (no full count needed)."""
    return not selection.isEmpty()


def articles_of_search(articles: DataFrame, searches: DataFrame, search_id: str) -> DataFrame:
    """Every article of the search with the given search_id (empty when unknown)."""
    s = searches.filter(F.col("search_id") == search_id).select(F.col("id").alias("_sid"))
    return articles.join(s, articles["search_pk"] == s["_sid"], "inner").drop("_sid")


def page(df: DataFrame, number: int, size: int = 10, order: list[Column] | None = None) -> DataFrame:
    """Page ``number`` (1-based) of ``size`` rows in ``order`` (default id)."""
    o = order or [F.col("id")]
    return df.orderBy(*o).offset(size * (number - 1)).limit(size)


def lookup_by_key(articles: DataFrame, requests: DataFrame, key_col: str = "key") -> DataFrame:
    """K6 + P9: requests carrying base64 URL keys -> the stored articles."""
    r = requests.withColumn("_url", ux.decode_key(F.col(key_col)))
    return r.join(articles, r["_url"] == articles["article_url"], "inner").drop("_url")


def admin_search(articles: DataFrame, translated=None, processed=None, pushed=None,
                 url_contains: str | None = None, search_contains: str | None = None) -> DataFrame:
    """Facet filters plus case-insensitive contains on url / search id."""
    a = articles
    for col, v in (("translated", translated), ("processed", processed), ("pushed", pushed)):
        if v is not None:
            a = a.filter(F.col(col) == v)
    if url_contains:
        a = a.filter(F.col("article_url").ilike(f"%{url_contains}%"))
    if search_contains:
        a = a.filter(F.col("search_id").ilike(f"%{search_contains}%"))
    return a


def image_worklist(articles: DataFrame) -> DataFrame:
    """K7: articles with an image URL, no stored image, and an image extension;
    with the deterministic file name the image would be stored under."""
    w = articles.filter((F.coalesce(F.col("top_image_url"), F.lit("")) != "") &
                        (F.coalesce(F.col("top_image"), F.lit("")) == "") &
                        ux.is_image_url(F.col("top_image_url")))
    ext = F.lower(F.regexp_extract(F.col("top_image_url"), r"\.([A-Za-z0-9]+)$", 1))
    return w.withColumn("image_file", ux.asset_name(F.col("top_image_url"), ext))


def lookups(spark) -> tuple[DataFrame, DataFrame]:
    """K8: the source and search-type enumerations."""
    return (spark.createDataFrame(list(zip(SOURCES, SOURCE_LABELS)), "value string, label string"),
            spark.createDataFrame(list(zip(SEARCH_TYPES, SEARCH_TYPE_LABELS)), "value string, label string"))


def quota_decisions(calls: DataFrame, key: str, ts: str, volume: str, tiebreak: str) -> DataFrame:
    """A call is admitted when the same key's previous call was less than
    2 minutes earlier and moved at most 2000 characters; otherwise it hits the
    TIME (no recent call) or VOLUME limit. A key's first call is FIRST."""
    lagged = keyed_lag(calls, key, [F.col(key), F.col(ts), F.col(tiebreak)], [ts, volume])
    gap = F.unix_micros(F.col(ts)) - F.unix_micros(F.col("prev_" + ts))
    decision = (F.when(F.col("prev_" + ts).isNull(), F.lit("FIRST"))
                .when(gap >= QUOTA_WINDOW_SECONDS * 1_000_000, F.lit("TIME"))
                .when(F.col("prev_" + volume) <= QUOTA_VOLUME, F.lit("OK"))
                .otherwise(F.lit("VOLUME")))
    return lagged.withColumn("gap_ms", F.floor(gap / 1000)).withColumn("decision", decision)
