"""Page -> article extraction.

Two paths:

* the native fast path (X1): title from ``<title>``, main content from the
  first ``<article>`` (then ``<main>``, then ``<body>``) with regular
  expressions, all inside codegen;
* the tree passes (``functions/htmltree.py``): X1 scoring for pages that mark no article, and the tag harvest (X2-X5,
  X8), one ``mapInPandas`` pass that emits per page the few attributes the precedence rules need. Precedence
  and assembly stay in Spark expressions; dates go through the grammar of ``functions/dates.py``.

Only the harvest crosses to Python; keep ``html`` out of every plan after it.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill.functions import htmltree
from pressmill.functions import text as tx
from pressmill.functions.charset import page_text, sniff
from pressmill.functions.dates import first_date, parse_date
from pressmill.functions.urls import is_html
from pressmill.schemas import DATE_CLASS_PATTERN, DATE_META_KEYS
from pressmill.session import small_batches


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def successful(responses: DataFrame) -> DataFrame:
    """Keep successful responses, address them by their final URL."""
    return (responses.filter(F.coalesce(F.col("status"), F.lit(200)) < 400)
            .withColumn("article_url", F.coalesce(F.col("final_url"), F.col("url"))))


def decoded(responses: DataFrame) -> DataFrame:
    """A BINARY ``payload`` as text, in the charset that its mark, header, meta tag or bytes tell; text stays."""
    if not isinstance(responses.schema["payload"].dataType, T.BinaryType):
        return responses
    rest = [c for c in responses.columns if c != "payload"]
    charset = F.col("charset") if "charset" in rest else None
    # one-element generators: a plain projection would be copied into every expression that reads the payload
    named = responses.select(*rest, "payload", F.explode(F.array(sniff(F.col("payload"), F.col("content_type"), charset))).alias("_charset"))
    return named.select(*rest, F.explode(F.array(page_text(F.col("payload"), F.col("_charset")))).alias("payload")).select(*responses.columns)


def rejected(responses: DataFrame, key: str = "url") -> DataFrame:
    """(key, reason) of responses that become no article: the request failed, or nothing is left of the body."""
    failed = F.coalesce(F.col("status"), F.lit(200)) >= 400
    kept = page_articles(responses, density_fallback=True).select(F.col(key).alias("_kept")).distinct()
    rest = responses.filter(~failed).select(key).join(kept, F.col(key) == F.col("_kept"), "left_anti")
    return (responses.filter(failed).select(key, F.concat(F.lit("http "), F.col("status")).alias("reason"))
            .unionByName(rest.select(key, F.lit("no body text").alias("reason"))))


def pages_as_responses(pages: DataFrame) -> DataFrame:
    """The landed-page table as responses: every page was fetched with 200 text/html."""
    return pages.select(
        "page_id",
        F.col("url"),
        F.col("url").alias("final_url"),
        F.lit(200).alias("status"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.lit("utf-8").alias("charset"),
        F.col("html").alias("payload"),
    )


def title_of(html) -> Column:
    """Text of the first <title>."""
    t = F.regexp_extract(_c(html), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return tx.strip(tx.collapse_ws(tx.unescape_html(tx.untag(t))))


def articles_html(html) -> Column:
    """Inner HTML of all outermost <article> elements, '' if none is closed. End
    tags are matched by depth; what is still open after the last end tag ends there."""
    closed = F.regexp_extract(_c(html), r"(?is)^(.*)</article\s*>", 1)
    # every piece begins with a start or end tag, but for text before the first
    pieces = F.split(closed, r"(?i)(?=</?article\b)")

    def step(state, piece):
        begin, end, depth = piece.rlike(r"(?i)^<article\b"), piece.rlike(r"(?i)^</article\b"), state["depth"]
        after = F.when(begin, depth + 1).when(end, F.greatest(depth - 1, F.lit(0))).otherwise(depth)
        kept = (F.when(begin & (depth == 0), F.regexp_replace(piece, r"(?is)^<article\b[^>]*>", "\n"))
                .when(after > 0, piece).otherwise(F.lit("")))
        return F.struct(after.alias("depth"), F.concat(state["kept"], F.array(kept)).alias("kept"))

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))
    return F.regexp_replace(F.aggregate(pieces, start, step, lambda state: F.array_join(state["kept"], "")), r"^\n", "")


def main_html(html) -> Column:
    """X1 fast path: inner HTML of the outermost <article>s, else of <main>, else of <body>."""
    h = _c(html)
    # the depth is only counted on pages with more than one start tag
    art = (F.when(h.rlike(r"(?is)<article\b.*<article\b"), articles_html(h))
           .otherwise(F.regexp_extract(h, r"(?is)<article\b[^>]*>(.*?)</article>", 1)))
    main = F.regexp_extract(h, r"(?is)<main\b[^>]*>(.*?)</main>", 1)
    body = F.regexp_extract(h, r"(?is)<body\b[^>]*>(.*?)</body>", 1)
    return F.coalesce(tx.non_empty(art), tx.non_empty(main), body)


def author_list(authors) -> Column:
    """A list of author names as one string."""
    return F.array_join(_c(authors), ", ")


def prefer(*cols: Column) -> Column:
    """Trust-ordered merge, most trusted first; NULL or '' never overrides."""
    return F.coalesce(*[tx.non_empty(c) for c in cols[:-1]], cols[-1])


def page_articles(responses: DataFrame, candidates: DataFrame | None = None,
                  density_fallback: bool = False) -> DataFrame:
    """X9 without language: responses (+ optional initial candidate fields)
    -> cleaned articles. Rows with an empty cleaned body are dropped (T4);
    non-HTML responses keep the initial title/body and become trash (G4).

    With ``density_fallback`` the pages that have neither ``<article>`` nor
    ``<main>`` (and only those) cross to Python, which scores their trees;
    all other pages stay on the native path. Binary payloads are decoded first."""
    r = decoded(successful(responses))
    if candidates is not None:
        c = candidates.select(F.col("article_url").alias("_req_url"),
                              F.col("title").alias("init_title"), F.col("body").alias("init_body"),
                              F.col("post_date_created").alias("init_date"))
        r = r.join(c, r["url"] == c["_req_url"], "left").drop("_req_url")
    else:
        r = (r.withColumn("init_title", F.lit(None).cast("string"))
             .withColumn("init_body", F.lit(None).cast("string"))
             .withColumn("init_date", F.lit(None).cast("string")))
    html = is_html(F.col("content_type"))
    r = r.withColumn("is_html", html).withColumn("_main", main_html("payload"))
    if density_fallback:
        structured = F.col("payload").rlike(r"(?i)<(article|main)\b")
        fast = r.filter(~F.col("is_html") | structured)
        r = fast.unionByName(scored_content(r.filter(F.col("is_html") & ~structured)))
    title = F.when(F.col("is_html"), prefer(title_of("payload"), F.col("init_title"))).otherwise(F.col("init_title"))
    raw_body = F.when(F.col("is_html"), prefer(F.col("_main"), F.col("init_body"))).otherwise(F.col("init_body"))
    body = tx.collapse_ws(tx.clean_html(raw_body))
    keep = [c for c in r.columns if c not in ("payload", "init_title", "init_body", "_main")]
    # T4 as a 0-or-1 element generator: a plain filter on ``body`` would be
    # pushed below the projection and run the whole cleaning chain twice
    return r.select(*keep, title.alias("title"),
                    F.explode(F.filter(F.array(body), lambda b: F.length(b) > 0)).alias("body"))


# ---------------------------------------------------------------------------
# Tag harvest (Python, per partition, Arrow batches)
# ---------------------------------------------------------------------------
HARVEST_SCHEMA = T.StructType([
    T.StructField("ld_author", T.StringType()),
    T.StructField("ld_published", T.StringType()),
    T.StructField("ld_created", T.StringType()),
    T.StructField("meta_author", T.StringType()),
    T.StructField("itemprop_author", T.StringType()),
    T.StructField("rel_author", T.StringType()),
    T.StructField("class_author", T.StringType()),
    T.StructField("meta_date", T.StringType()),
    T.StructField("time_date", T.StringType()),
    T.StructField("span_date", T.StringType()),
    T.StructField("class_dates", T.ArrayType(T.StringType())),
    T.StructField("og_image", T.StringType()),
    T.StructField("first_img", T.StringType()),
])

_DATE_CLASS = re.compile(DATE_CLASS_PATTERN, re.IGNORECASE)


def _meta_date(metas):
    for m in metas:
        for attr, key in DATE_META_KEYS:
            if m.get(attr, "").lower() == key:
                return (m.get("content") or "").strip()
    return None


def _meta_author(metas):
    for m in metas:
        if m.get("name", "").lower() in ("author", "blogger_name"):
            return (m.get("content") or "").strip()
    return None


def _og_image(metas):
    for m in metas:
        if m.get("property", "").lower() == "og:image" and m.get("content"):
            return m["content"]
    return None


def _text_or_none(value):
    """A linked-data value as text; a list gives its first text, anything else none."""
    if isinstance(value, list):
        value = next((v for v in value if isinstance(v, str)), None)
    return value if isinstance(value, str) else None


def _linked_data(nodes) -> dict:
    """The first linked-data script, if it is an object."""
    script = next((n for n in nodes if n.tag == "script" and n.attrs.get("type", "").lower() == "application/ld+json"), None)
    try:
        data = json.loads(script.text()) if script is not None else None
    except ValueError:  # bad JSON says nothing
        return {}
    return data if isinstance(data, dict) else {}


def harvest_one(html: str | None) -> dict:
    """What the author, date and image rules look at, taken from the tree in document order."""
    out = {f.name: None for f in HARVEST_SCHEMA.fields}
    if not html:
        return out
    root = htmltree.parse(html)
    nodes = list(root.nodes())
    metas = [n.attrs for n in nodes if n.tag == "meta"]
    data = _linked_data(nodes)
    if isinstance(data.get("author"), dict):
        out["ld_author"] = _text_or_none(data["author"].get("name"))
    out["ld_published"], out["ld_created"] = _text_or_none(data.get("datePublished")), _text_or_none(data.get("dateCreated"))
    class_dates = []
    for n in nodes:
        cls, prop = n.attrs.get("class", ""), n.attrs.get("itemprop", "")
        if prop.lower() == "author" and n.tag != "meta":
            out["itemprop_author"] = n.text().strip() or n.attrs.get("content")
        if n.tag == "a" and "author" in n.attrs.get("rel", "").lower().split():
            out["rel_author"] = n.text().strip()
        if "art-author" in cls.lower():
            out["class_author"] = n.text().strip()
        if n.tag == "time" and out["time_date"] is None:
            if n.attrs.get("datetime"):
                out["time_date"] = n.attrs["datetime"]
            elif n.classes()[:1] and n.classes()[0].lower() == "timestamp":
                out["time_date"] = n.text().strip()
        if n.tag == "span" and prop == "datePublished" and out["span_date"] is None:
            out["span_date"] = n.attrs["content"] if "content" in n.attrs else n.text().strip()
        if n.tag == "img" and out["first_img"] is None and n.attrs.get("src"):
            out["first_img"] = n.attrs["src"]
        if cls and _DATE_CLASS.search(cls):
            class_dates.append(n.text().strip())
    out["meta_author"], out["meta_date"], out["og_image"] = _meta_author(metas), _meta_date(metas), _og_image(metas)
    out["class_dates"] = class_dates or None
    root.release()
    return out


def _harvest_batches(it, key_cols):
    for pdf in it:
        rows = [harvest_one(x) for x in pdf["payload"]]
        res = pd.DataFrame(rows, columns=[f.name for f in HARVEST_SCHEMA.fields])
        yield pd.concat([pdf[key_cols].reset_index(drop=True), res], axis=1)


def harvest_tags(responses: DataFrame, key_cols=("url",)) -> DataFrame:
    """One Python pass over the HTML; output carries ``key_cols`` + HARVEST_SCHEMA."""
    key_cols = list(key_cols)
    key_fields = [responses.schema[k] for k in key_cols]
    schema = T.StructType(key_fields + HARVEST_SCHEMA.fields)
    cols = key_cols + ([] if "payload" in key_cols else ["payload"])
    small_batches(responses.sparkSession)
    return responses.select(*cols).mapInPandas(lambda it: _harvest_batches(it, key_cols), schema)


def scored_content(responses: DataFrame, out: str = "_main") -> DataFrame:
    """X1 for pages that mark no article: ``out`` becomes the inner HTML of the part of the tree that scores best; a page
    without any text keeps its ``out``."""
    def run(it):
        for pdf in it:
            best = [htmltree.content_html(x) if x else None for x in pdf["payload"]]
            pdf[out] = [old if new is None else new for new, old in zip(best, pdf[out])]
            yield pdf

    small_batches(responses.sparkSession)
    return responses.mapInPandas(run, responses.schema)


# ---------------------------------------------------------------------------
# Dates (X6) and precedence
# ---------------------------------------------------------------------------
def article_meta(harvest: DataFrame, anchor: Column | None = None) -> DataFrame:
    """Authors, published date and top image per page from the harvest. ``anchor`` is the time that relative dates and
    dates without a year go by."""
    h = harvest
    # HTML sources override LD-JSON; the later HTML rules override earlier ones
    author = prefer(F.col("class_author"), F.col("rel_author"), F.col("itemprop_author"),
                    F.col("meta_author"), F.col("ld_author"))
    ld_date = F.coalesce(parse_date("ld_published", anchor), parse_date("ld_created", anchor))   # X3
    meta_date = parse_date("meta_date", anchor)                                                 # X4
    class_date = first_date("class_dates", anchor)
    tag_date = F.when(F.col("time_date").isNotNull(), parse_date("time_date", anchor)).otherwise(
        F.when(F.col("span_date").isNotNull(), parse_date("span_date", anchor)).otherwise(class_date))  # X5
    published = F.coalesce(ld_date, meta_date, tag_date)                                  # X7
    image = F.coalesce(F.nullif(F.col("og_image"), F.lit("")), F.col("first_img"))       # X8
    keys = [c for c in h.columns if c not in HARVEST_SCHEMA.fieldNames()]
    return h.select(*keys, F.coalesce(author, F.lit("")).alias("authors"),
                    published.alias("post_ts"),
                    F.date_format(published, "yyyy-MM-dd HH:mm:ss").alias("post_date_created"),
                    F.coalesce(image, F.lit("")).alias("top_image_url"))
