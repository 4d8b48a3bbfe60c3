"""Landed search results and feeds -> candidate rows.

Payloads are columns (one response per row) parsed with declared schemas
(``from_xml`` / ``from_json``); files are read with the built-in ``xml`` /
``json`` / ``text`` sources and the same schemas. Nothing is inferred.
Rows whose payload is an error are routed to a separate output instead of
failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.functions import text as tx
from pressmill.functions.urls import unwrap_redirect
from pressmill.schemas import CSE_PAGE, RSS_DOC, SOCIAL_PAGE, XML_SEARCH_DOC

_DOCS = "array<struct<url: string, title: string, passages: string>>"
RSS_ITEM = "title STRING, link STRING, description STRING, pubDate STRING"


def candidate(url: Column, title: Column, body: Column) -> list[Column]:
    """The candidate triple, Unicode-stripped."""
    return [tx.strip(url).alias("article_url"), tx.strip(title).alias("title"), tx.strip(body).alias("body")]


def rss_time(pub_date: Column) -> Column:
    """RFC 822 date -> UTC timestamp; the weekday name is dropped first
    (pattern letter E cannot parse), a bad date gives NULL."""
    s = F.regexp_replace(pub_date, r"^\s*[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(s, F.lit("d MMM yyyy HH:mm:ss Z")),
                      F.try_to_timestamp(s, F.lit("d MMM yyyy HH:mm:ss z")),
                      F.try_to_timestamp(s, F.lit("d MMM yyyy HH:mm Z")))


def parse_rss(df: DataFrame, payload: str = "payload", unwrap_param: str | None = None) -> DataFrame:
    """S1 (S8 with ``unwrap_param='url'``): one candidate per feed item, with
    its position in the feed and the published time in UTC."""
    keys = [c for c in df.columns if c != payload]
    x = df.select(*keys, F.from_xml(F.col(payload), RSS_DOC).alias("_x"))
    items = x.select(*keys, F.posexplode("_x.channel.item").alias("item_no", "_i"))
    link = F.col("_i.link")
    if unwrap_param:
        link = unwrap_redirect(link, unwrap_param)
    published = rss_time(F.col("_i.pubDate"))
    return items.select(*keys, "item_no", *candidate(link, F.col("_i.title"), F.col("_i.description")),
                        F.date_format(published, "yyyy-MM-dd HH:mm:ss").alias("post_date_created"),
                        published.alias("post_ts"))


def read_rss_files(spark: SparkSession, path: str) -> DataFrame:
    """S1 over files: the ``xml`` source with rowTag ``item`` (CDATA kept)."""
    items = (spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path))
    published = rss_time(F.col("pubDate"))
    return items.select(*candidate(F.col("link"), F.col("title"), F.col("description")),
                        F.date_format(published, "yyyy-MM-dd HH:mm:ss").alias("post_date_created"),
                        published.alias("post_ts"))


def parse_cse(df: DataFrame, request: str, payload: str = "payload") -> DataFrame:
    """JSON result pages -> items. If any page of a request has no
    ``items`` the whole request yields nothing. The rule is a per-request
    aggregate (combined map-side) joined back, so a huge request is never
    gathered into one task."""
    keys = [c for c in df.columns if c != payload]
    x = df.select(*keys, F.from_json(F.col(payload), CSE_PAGE).alias("_x"))
    complete = (x.groupBy(request).agg(F.bool_and(F.col("_x.items").isNotNull()).alias("_ok"))
                .filter("_ok").select(request))
    items = x.join(complete, request, "left_semi").select(*keys, F.posexplode("_x.items").alias("item_no", "_i"))
    return items.select(*keys, "item_no", *candidate(F.col("_i.link"), F.col("_i.title"), F.col("_i.snippet")))


def parse_social(df: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """S3: (posts, errors). A post becomes (url, 'network - @user', text);
    a payload without ``posts`` goes to the error output."""
    keys = [c for c in df.columns if c != payload]
    x = df.select(*keys, F.from_json(F.col(payload), SOCIAL_PAGE).alias("_x"))
    ok = x.filter(F.col("_x.posts").isNotNull())
    posts = ok.select(*keys, F.posexplode("_x.posts").alias("item_no", "_p"))
    title = F.concat(F.col("_p.network"), F.lit(" - @"), F.col("_p.user.name"))
    posts = posts.select(*keys, "item_no", *candidate(F.col("_p.url"), title, F.col("_p.text")))
    errors = x.filter(F.col("_x.posts").isNull()).select(
        *keys, F.lit("Social search returned empty result").alias("error"))
    return posts, errors


def parse_xml_search(df: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, totals, errors) of XML search responses.

    items: url, recursive text of title and passages ('' when absent);
    totals: first ``found`` of the response, its human text, page count
    ``found / 10`` capped at 100; errors: (code or 0, description). A
    response with an error yields no items and no totals."""
    keys = [c for c in df.columns if c != payload]
    x = df.select(*keys, F.from_xml(F.col(payload), XML_SEARCH_DOC).alias("_x"))
    err = F.col("_x.response.error")
    good = x.filter(err.isNull())
    # a group may hold several docs, or none
    every = F.flatten(F.transform("_x.response.results.grouping.group",
                                  lambda g: F.coalesce(g["doc"], F.array().cast(_DOCS))))
    docs = good.select(*keys, F.posexplode(every).alias("item_no", "_d"))
    items = docs.select(*keys, "item_no", *candidate(
        F.coalesce(F.col("_d.url"), F.lit("")),
        F.coalesce(tx.untag(F.col("_d.title")), F.lit("")),
        F.coalesce(tx.untag(F.col("_d.passages")), F.lit(""))))
    found = F.coalesce(F.get(F.col("_x.response.found"), 0)["_VALUE"], F.lit(0))
    totals = good.select(*keys, found.alias("found"), F.col("_x.response.`found-human`").alias("found_human"),
                         F.least(found / 10.0, F.lit(100.0)).alias("pages"))
    errors = x.filter(err.isNotNull()).select(
        *keys, F.coalesce(F.col("_x.response.error._code").try_cast("int"), F.lit(0)).alias("code"),
        F.col("_x.response.error._VALUE").alias("description"))
    return items, totals, errors


def read_url_lines(spark: SparkSession, path: str) -> DataFrame:
    """A text file of URLs, one per line; blank lines are skipped; the
    rows carry no search."""
    lines = spark.read.text(path)
    return (lines.select(tx.strip(F.col("value")).alias("article_url"))
            .filter(F.col("article_url") != "").withColumn("search_pk", F.lit(None).cast("bigint")))


def read_link_objects(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects -> their ``link`` values."""
    return (spark.read.option("multiLine", True).schema("link STRING").json(path)
            .select(F.col("link").alias("article_url")).filter(F.col("article_url").isNotNull()))
