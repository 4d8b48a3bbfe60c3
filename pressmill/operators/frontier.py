"""URL frontier over saved searches.

``now`` is always a parameter: scheduler decisions never read the clock
inside a plan, so a re-run (or a retried task) decides the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.schemas import EMAIL_LINKS, ENGINE_PAGING, ENGINE_REQUESTS, OPTION_ENGINES, OPTIONS, SOURCES


def _ts(now) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def period_interval(period: Column) -> Column:
    """hourly / daily / weekly; anything else is 30 days."""
    return (F.when(period == "hourly", F.expr("INTERVAL 1 HOUR"))
            .when(period == "daily", F.expr("INTERVAL 1 DAY"))
            .when(period == "weekly", F.expr("INTERVAL 7 DAYS"))
            .otherwise(F.expr("INTERVAL 30 DAYS")))


def is_due(now, active="active", last="last_processed", period="period") -> Column:
    """active and never run, or the period has strictly passed."""
    n = _ts(now)
    lp = F.col(last)
    return F.col(active) & (lp.isNull() | ((n - lp) > period_interval(F.col(period))))


def due_searches(searches: DataFrame, now) -> DataFrame:
    return searches.filter(is_due(now))


def advance_schedule(searches: DataFrame, now) -> DataFrame:
    """due searches get ``last_processed = now`` (found anything or not)."""
    return searches.withColumn(
        "last_processed", F.when(is_due(now), _ts(now)).otherwise(F.col("last_processed")))


def source_list(source: Column) -> Column:
    """the engine list 'a, b' as an array."""
    return F.split(source, ", ")


def invalid_sources(source: Column) -> Column:
    """F8: listed engines that are not known."""
    return F.array_except(source_list(source), F.array(*[F.lit(s) for s in SOURCES]))


def email_link_rows(email_links: Column) -> Column:
    """all links of a mailbox JSON column; NULL column -> no links."""
    m = F.from_json(email_links, EMAIL_LINKS)
    return F.coalesce(
        F.flatten(F.transform(F.map_values(m), lambda v: F.coalesce(v["links"], F.array().cast("array<string>")))),
        F.array().cast("array<string>"))


def search_work(searches: DataFrame, now, email_rows: DataFrame | None = None) -> DataFrame:
    """F3 + F2 + F4 + F12: due searches routed by type into work rows
    ``(search_pk, kind, target, engine, depth, options)``."""
    due = due_searches(searches, now)
    base = due.select(F.col("id").alias("search_pk"), "search_type", "query", "source", "search_depth",
                      "options", "rss_link", "article_url")
    engines = (base.filter(F.col("search_type").isin("search_engine", "simple_search"))
               .select("search_pk", F.lit("engine").alias("kind"), F.col("query").alias("target"),
                       F.explode(source_list(F.col("source"))).alias("engine"),
                       F.col("search_depth").alias("depth"), "options"))
    feeds = (base.filter(F.col("search_type") == "rss")
             .select("search_pk", F.lit("rss").alias("kind"), F.col("rss_link").alias("target"),
                     F.lit(None).cast("string").alias("engine"), F.lit(None).cast("int").alias("depth"),
                     F.lit(None).cast("string").alias("options")))
    single = (base.filter(F.col("search_type") == "article")
              .select("search_pk", F.lit("url").alias("kind"), F.col("article_url").alias("target"),
                      F.lit(None).cast("string").alias("engine"), F.lit(None).cast("int").alias("depth"),
                      F.lit(None).cast("string").alias("options")))
    out = engines.unionByName(feeds).unionByName(single)
    if email_rows is not None:
        mail_due = due.filter(F.col("search_type") == "email").select(F.col("id").alias("_pk"))
        mail = (email_rows.join(mail_due, email_rows["search_pk"] == mail_due["_pk"], "left_semi")
                .select("search_pk", F.lit("url").alias("kind"),
                        F.explode(email_link_rows(F.col("email_links"))).alias("target"),
                        F.lit(None).cast("string").alias("engine"), F.lit(None).cast("int").alias("depth"),
                        F.lit(None).cast("string").alias("options")))
        out = out.unionByName(mail)
    return out


def engine_spec(spark) -> DataFrame:
    return spark.createDataFrame(
        ENGINE_PAGING, "engine string, kind string, step int, base int, max_depth int")


def _map(pairs: dict) -> Column:
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[x if isinstance(x, Column) else F.lit(x) for kv in pairs.items() for x in kv])


def engine_request(start: Column, size: Column, params: Column) -> list[Column]:
    """``address`` and ``request`` (all parameters by name) of a request page; ``params`` override the
    engine's own. Engines with a client library of their own have no address and only ``params``."""
    address, own = F.lit(None).cast("string"), _map({})
    for engine, url, fixed, position, count in ENGINE_REQUESTS:
        pairs = dict(fixed)
        if position:
            pairs[position] = start.cast("string")
        if count:
            pairs[count] = size.cast("string")
        address = F.when(F.col("engine") == engine, F.lit(url)).otherwise(address)
        own = F.when(F.col("engine") == engine, _map(pairs)).otherwise(own)
    kept = F.map_filter(own, lambda k, _: ~F.map_contains_key(params, k))
    return [address.alias("address"), F.map_concat(kept, params).alias("request")]


def request_plan(work: DataFrame, spec: DataFrame) -> DataFrame:
    """F5 + F6 + F9: engine work rows -> one row per request page.

    Unknown engines get no pages (``engine_errors`` lists them). Depth is
    clamped per engine; depth 0 gives no page. Options decoded from JSON
    override request parameters of the engines that take them (last value wins).
    ``params`` are the query and the options, ``request`` all parameters sent to ``address``."""
    w = work.filter(F.col("kind") == "engine").drop("kind")
    s = F.broadcast(spec.withColumnRenamed("kind", "paging"))
    j = w.join(s, "engine", "inner")
    depth = F.least(F.coalesce(F.col("depth"), F.lit(0)),
                    F.coalesce(F.col("max_depth"), F.col("depth"), F.lit(0)))
    pages = (F.when(F.col("paging") == "paged",
                    F.when(depth > 0, F.sequence(F.lit(0), depth - 1)).otherwise(F.array().cast("array<int>")))
             .when(F.col("paging") == "single",
                   F.when(depth > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))
             .otherwise(F.array(F.lit(0))))
    none = F.create_map().cast("map<string,string>")
    j = j.withColumn("_options", F.when(F.col("engine").isin(*OPTION_ENGINES),
                                        F.coalesce(F.from_json(F.col("options"), OPTIONS), none)).otherwise(none))
    own = F.map_filter(F.create_map(F.lit("q"), F.col("target")), lambda k, _: ~F.map_contains_key("_options", k))
    params = F.map_concat(own, "_options")
    j = j.select("search_pk", "engine", "paging", "step", "base", depth.alias("depth"),
                 F.explode(pages).alias("page"), params.alias("params"))
    start = F.when(F.col("paging") == "paged", F.col("base") + F.col("step") * F.col("page"))
    size = F.when(F.col("paging") == "single", F.col("step") * F.col("depth"))
    j = j.select("search_pk", "engine", "page", start.alias("start"), size.alias("size"), "params")
    return j.select("*", *engine_request(F.col("start"), F.col("size"), F.col("params")))


def engine_errors(work: DataFrame, spec: DataFrame) -> DataFrame:
    """work rows naming an engine that has no parser."""
    w = work.filter(F.col("kind") == "engine")
    return w.join(F.broadcast(spec.select("engine")), "engine", "left_anti")


def normalise_candidates(df: DataFrame, col: str = "candidate") -> DataFrame:
    """a candidate is a bare URL string or a partial candidate struct;
    both become the full candidate struct."""
    dt = df.schema[col].dataType.simpleString()
    if dt == "string":
        return df.withColumn(col, F.struct(F.col(col).alias("article_url"),
                                           F.lit(None).cast("string").alias("title"),
                                           F.lit(None).cast("string").alias("body"),
                                           F.lit(None).cast("string").alias("post_date_created")))
    return df


def new_urls(candidates: DataFrame, store: DataFrame, key: str = "article_url") -> DataFrame:
    """Candidates not yet in the store, once each.

    The in-batch de-dup is a map-side-combined aggregate; the anti-join
    shuffles both sides on the URL (the store is never broadcast)."""
    return (candidates.dropDuplicates([key])
            .join(store.select(key).dropDuplicates([key]), key, "left_anti"))


def non_empty_lists(df: DataFrame, col: str = "url_list") -> DataFrame:
    """url_list must be a non-empty list."""
    return df.filter(F.coalesce(F.size(F.col(col)) > 0, F.lit(False)))
