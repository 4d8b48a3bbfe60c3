"""Shipped queries: name -> (spark, sf_dir) -> DataFrame, and their SQL checks.

Every query reads the shipped tables (or tables Spark derives from them in
``derive.py``) in full; limits appear only where the limit is the feature
(paging, top-k).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.functions import text as tx
from pressmill.functions import urls as ux
from pressmill.operators import dedup, extract, frontier, triage
from pressmill.plans import derive
from pressmill.plans import oracle_sql as O
from pressmill.schemas import ENGINE_REQUESTS
from pressmill.session import ensure_conf, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_conf(spark)
            return _widen_ints(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run
    return wrap


def _widen_ints(df: DataFrame) -> DataFrame:
    """Integer outputs are BIGINT (the SQL checks produce BIGINT counts/lengths)."""
    small = {"int", "smallint", "tinyint"}
    if not any(t in small for _, t in df.dtypes):
        return df
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in small else F.col(c) for c, t in df.dtypes])


def _ts_text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# ---------------------------------------------------------------------------
# Pages -> articles, triage
# ---------------------------------------------------------------------------
def _page_articles(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    return extract.page_articles(extract.pages_as_responses(pages))


@query("page_articles", f"""
WITH {O.PAGE_ARTICLES_CTE}
SELECT page_id, article_url, title, length(body) AS n_chars, sha256(body) AS body_digest,
       {O.initial_status(O.trash_exists('article_url', 'body'), 'CAST(NULL AS VARCHAR)')} AS status
FROM page_art WHERE length(body) > 0
""")
def page_articles(spark, sf_dir):
    """S11 + X1 + T1-T4 + J3 + G1: landed pages -> cleaned articles with status."""
    a = triage.mark_trash(_page_articles(spark, sf_dir), derive.trash_rules(spark))
    return a.select("page_id", "article_url", "title", F.length("body").alias("n_chars"),
                    F.sha2(F.col("body"), 256).alias("body_digest"),
                    triage.initial_status(F.col("is_trash"), F.lit(None).cast("string")).alias("status"))


@query("trash_matches", f"""
WITH {O.PAGE_ARTICLES_CTE}
SELECT a.page_id, CAST(r.id AS BIGINT) AS rule_id
FROM page_art a, {O.rules_values()}
WHERE length(a.body) > 0
  AND (a.article_url IS NULL OR coalesce(regexp_matches(a.article_url, r.url), false))
  AND (a.body = '' OR (coalesce(regexp_matches(a.body, r.text), false)
                       AND (r.length = 0 OR length(a.body) <= r.length)))
""")
def trash_matches(spark, sf_dir):
    """J3 pairs: which rule trashes which page article."""
    return triage.trash_hits(_page_articles(spark, sf_dir), derive.trash_rules(spark), key="page_id")


def _articles_with_search(spark, sf_dir):
    arts = derive.articles(spark, sf_dir)
    return arts, derive.searches(spark, sf_dir)


@query("article_status", f"""
WITH {O.ARTICLES_CTE}, {O.SEARCHES_CTE},
joined AS (
    SELECT a.id, a.article_url, a.body, CASE WHEN s.id IS NOT NULL THEN s.channel ELSE a.channel END AS channel,
           s.search_id
    FROM articles a LEFT JOIN searches s ON a.search_pk = s.id)
SELECT id, search_id, channel, {O.initial_status(O.trash_exists('article_url', 'body'), 'channel')} AS status
FROM joined
""")
def article_status(spark, sf_dir):
    """J1 + G2 (+ J3, G1): article store joined to its search; channel from the
    search, status from the rules."""
    arts, searches = _articles_with_search(spark, sf_dir)
    out = triage.assign_status(arts, derive.trash_rules(spark), searches)
    s = searches.select(F.col("id").alias("_sid"), "search_id")
    return (out.join(s, out["search_pk"] == s["_sid"], "left")
            .select("id", "search_id", "channel", "status"))


@query("status_changes", f"""
WITH {O.ARTICLES_CTE}, {O.SEARCHES_CTE},
joined AS (
    SELECT a.id, a.article_url, a.body, s.channel,
           CASE WHEN s.channel IN ('industry', 'research', 'government', 'other', 'general') THEN 'keep'
                ELSE 'raw' END AS status
    FROM articles a LEFT JOIN searches s ON a.search_pk = s.id),
re AS (SELECT id, status, {O.initial_status(O.trash_exists('article_url', 'body'), 'channel')} AS new_status
       FROM joined)
SELECT id, status, new_status FROM re WHERE status IS DISTINCT FROM new_status
""")
def status_changes(spark, sf_dir):
    """Statuses saved before the rules existed, re-evaluated; only changed rows."""
    arts, searches = _articles_with_search(spark, sf_dir)
    s = searches.select(F.col("id").alias("_sid"), F.col("channel").alias("_ch"))
    saved = (arts.join(s, arts["search_pk"] == s["_sid"], "left")
             .withColumn("channel", F.col("_ch"))
             .withColumn("status", triage.initial_status(F.lit(False), F.col("_ch")))
             .drop("_sid", "_ch"))
    return triage.status_changes(saved, derive.trash_rules(spark)).select("id", "status", "new_status")


# ---------------------------------------------------------------------------
# De-duplication
# ---------------------------------------------------------------------------
@query("dup_urls", f"""
WITH {O.ARTICLES_CTE}
SELECT article_url, count(*) AS n FROM articles GROUP BY article_url HAVING count(*) > 1
""")
def dup_urls(spark, sf_dir):
    """A1: URLs stored more than once."""
    return dedup.duplicate_report(derive.articles(spark, sf_dir).select("id", "article_url"))


@query("dedup_first", f"""
WITH {O.ARTICLES_CTE}
SELECT article_url, arg_min(id, id) AS id, arg_min(title, id) AS title FROM articles GROUP BY article_url
""")
def dedup_first(spark, sf_dir):
    """A2: keep the first (smallest id) article of each URL."""
    a = derive.articles(spark, sf_dir).select("id", "article_url", "title")
    return dedup.keep_first(a).select("article_url", "id", "title")


@query("dedup_last", f"""
WITH {O.ARTICLES_CTE}
SELECT article_url, arg_max(id, id) AS id, arg_max(title, id) AS title FROM articles GROUP BY article_url
""")
def dedup_last(spark, sf_dir):
    """A3: keep the last (largest id) article of each URL."""
    a = derive.articles(spark, sf_dir).select("id", "article_url", "title")
    return dedup.keep_last(a).select("article_url", "id", "title")


@query("page_host_dups", f"""
SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host, count(*) AS n
FROM pages GROUP BY 1 HAVING count(*) > 1
""")
def page_host_dups(spark, sf_dir):
    """A1 on landed pages: hosts that were fetched more than once."""
    pages = read_table(spark, sf_dir, "pages")
    return dedup.duplicate_report(
        pages.select(F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#:]+)", 1)).alias("host")), "host")


# ---------------------------------------------------------------------------
# Frontier
# ---------------------------------------------------------------------------
_SITE = r"^([A-Za-z]+://[^/?#]+)"


@query("frontier_new_urls", f"""
WITH links AS (
    SELECT CASE WHEN starts_with(h, '/') THEN regexp_extract(url, '{_SITE}', 1) || h ELSE h END AS article_url
    FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages)
    WHERE h <> '' AND NOT starts_with(h, '#'))
SELECT DISTINCT article_url FROM links WHERE article_url NOT IN (SELECT url FROM pages)
""")
def frontier_new_urls(spark, sf_dir):
    """F10 + F11/J4: links found on landed pages that are not stored yet, once each."""
    pages = read_table(spark, sf_dir, "pages")
    links = (pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("h"))
             .filter((F.col("h") != "") & ~F.startswith("h", F.lit("#"))))
    absolute = F.when(F.startswith("h", F.lit("/")),
                      F.concat(F.regexp_extract("url", _SITE, 1), F.col("h"))).otherwise(F.col("h"))
    cands = frontier.normalise_candidates(links.select(absolute.alias("candidate")))
    cands = cands.select(F.col("candidate.article_url").alias("article_url"))
    return frontier.new_urls(cands, pages.select(F.col("url").alias("article_url")))


# ---------------------------------------------------------------------------
# URL functions
# ---------------------------------------------------------------------------
@query("unwrap_links", """
WITH w AS (
    SELECT page_id, url,
           CASE WHEN page_id % 3 = 0 THEN 'https://www.google.com/url?q=' || url_encode(url) || '&sa=U'
                WHEN page_id % 3 = 1 THEN 'https://www.google.com/url?sa=U&q=' || url_encode(url_encode(url))
                ELSE url END AS href
    FROM pages),
d AS (SELECT page_id, url, href,
             url_decode(replace(nullif(regexp_extract(regexp_extract(href, '^[^#]*', 0), '[?&]q=([^&]*)', 1), ''), '+', ' ')) AS d1
      FROM w)
SELECT page_id, coalesce(url_decode(replace(d1, '+', '%2B')), d1, href) AS unwrapped,
       coalesce(url_decode(replace(d1, '+', '%2B')), d1, href) = url AS restored
FROM d
""")
def unwrap_links(spark, sf_dir):
    """Result links wrapped by a redirector (once or twice encoded) -> target URL."""
    pages = read_table(spark, sf_dir, "pages")
    kind = F.pmod(F.col("page_id"), F.lit(3))
    href = (F.when(kind == 0, F.concat(F.lit("https://www.google.com/url?q="), F.url_encode("url"), F.lit("&sa=U")))
            .when(kind == 1, F.concat(F.lit("https://www.google.com/url?sa=U&q="), F.url_encode(F.url_encode("url"))))
            .otherwise(F.col("url")))
    w = pages.select("page_id", "url", href.alias("href"))
    un = ux.unwrap_redirect(F.col("href"))
    return w.select("page_id", un.alias("unwrapped"), (un == F.col("url")).alias("restored"))


@query("url_flags", f"""
SELECT page_id,
       coalesce(regexp_matches(lower(url), '\\.(bmp|gif|ico|ief|jpe|jpeg|jpg|png|svg|tif|tiff|webp|ras|pnm|pbm|pgm|ppm|rgb|xbm|xpm|xwd|heic|heif|avif)$'), false) AS is_image,
       CASE WHEN length(url) > 30 THEN left(url, 27) || '...' ELSE url END AS short_url,
       to_base64(encode(url)) AS url_key,
       lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host
FROM pages
""")
def url_flags(spark, sf_dir):
    """Image test, short form and lookup key of every page URL."""
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", ux.is_image_url("url").alias("is_image"), ux.short_url("url").alias("short_url"),
                        ux.encode_key("url").alias("url_key"),
                        F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#:]+)", 1)).alias("host"))


# ---------------------------------------------------------------------------
# Text segmentation
# ---------------------------------------------------------------------------
def _doc_parts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", tx.translation_parts(F.col("text")).alias("parts"))


_SQL_PARTS = """
WITH w AS (
    SELECT doc_id, lang, list_filter(string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+'),
                                     lambda x: x <> '') AS words
    FROM documents),
s AS (
    SELECT doc_id, lang, words, array_to_string(words, ' ') AS joined FROM w),
p AS (
    SELECT doc_id, lang, CASE WHEN len(words) = 0 THEN ['']
        ELSE list_transform(
               string_split(regexp_replace(joined, '\\. ', '.' || chr(1), 'g') || CASE WHEN ends_with(joined, '.') THEN chr(1) ELSE ' ' END, chr(1)),
               lambda x: x) END AS sents
    FROM s),
k AS (
    SELECT doc_id, lang, list_reduce(sents,
        lambda acc, x: CASE WHEN length(acc.cur) + length(x) + 1 < 1000
                            THEN {'out': acc.out, 'cur': acc.cur || x || ' '}
                            ELSE {'out': list_append(acc.out, acc.cur), 'cur': x || ' '} END,
        {'out': []::VARCHAR[], 'cur': ''}) AS st
    FROM p)
"""


@query("doc_chunks", _SQL_PARTS + """
SELECT doc_id, lang, len(list_append(st.out, st.cur)) AS n_parts,
       sha256(array_to_string(list_append(st.out, st.cur), chr(2))) AS parts_digest,
       max_len AS max_part_len
FROM (SELECT doc_id, lang, st, list_max(list_transform(list_append(st.out, st.cur), lambda x: length(x))) AS max_len FROM k)
""")
def doc_chunks(spark, sf_dir):
    """T5: every document split into translation parts (< 1000 characters)."""
    p = _doc_parts(spark, sf_dir)
    return p.select("doc_id", "lang", F.size("parts").alias("n_parts"),
                    F.sha2(F.array_join("parts", "\u0002"), 256).alias("parts_digest"),
                    F.array_max(F.transform("parts", lambda x: F.length(x))).alias("max_part_len"))


@query("doc_paragraphs", f"""
WITH {O.paragraphs_cte('para', 'documents', 'doc_id', 'text')}
SELECT doc_id, n_pieces, n_groups, sha256(markup) AS markup_digest FROM para
""")
def doc_paragraphs(spark, sf_dir):
    """Every document untagged, cut into 10-sentence groups, quotes
    balanced and marked up as paragraphs."""
    docs = read_table(spark, sf_dir, "documents")
    groups = tx.sentence_groups(tx.untag(F.col("text")))
    pieces = tx.sentence_pieces(tx.untag(F.col("text")))
    return docs.select("doc_id", F.size(pieces).alias("n_pieces"), F.size(groups).alias("n_groups"),
                       F.sha2(tx.tag_p(groups), 256).alias("markup_digest"))


# ---------------------------------------------------------------------------
# Language
# ---------------------------------------------------------------------------
def _lang_model(spark, sf_dir):
    from pressmill.operators import lang
    docs = read_table(spark, sf_dir, "documents")
    return lang.load_or_train(docs.select("doc_id", "text", "lang"))


@query("doc_language", f"""
WITH {O.lang_model_cte()}, {O.detect_cte('det', 'documents', 'doc_id', 'text')}
SELECT d.doc_id, d.lang, det.detected FROM documents d JOIN det USING (doc_id)
""")
def doc_language(spark, sf_dir):
    """Trigram language scoring of every document (profiles from the corpus labels)."""
    from pressmill.operators import lang
    prof, prior = _lang_model(spark, sf_dir)
    docs = read_table(spark, sf_dir, "documents")
    det = lang.detect(docs.select("doc_id", "text"), prof, prior, "doc_id", "text")
    return docs.select("doc_id", "lang").join(det, "doc_id")


@query("page_language", f"""
WITH {O.PAGE_ARTICLES_CTE},
page_text AS (SELECT page_id, {O.untag('body')} AS t FROM page_art WHERE length(body) > 0),
{O.lang_model_cte()}, {O.detect_cte('det', 'page_text', 'page_id', 't')}
SELECT p.page_id, regexp_extract(p.html, '<html[^>]*\\slang="([^"]*)"', 1) AS declared, det.detected
FROM pages p JOIN det USING (page_id)
""")
def page_language(spark, sf_dir):
    """L1: language of each extracted page article (text of the cleaned body)."""
    from pressmill.operators import lang
    prof, prior = _lang_model(spark, sf_dir)
    arts = _page_articles(spark, sf_dir).select("page_id", tx.untag(F.col("body")).alias("t"))
    det = lang.detect(arts, prof, prior, "page_id", "t")
    pages = read_table(spark, sf_dir, "pages")
    return (pages.select("page_id", F.regexp_extract("html", r'<html[^>]*\slang="([^"]*)"', 1).alias("declared"))
            .join(det, "page_id"))


@query("language_agreement", f"""
WITH {O.lang_model_cte()},
titles AS (SELECT doc_id, split_part(text, chr(10), 1) AS t FROM documents),
{O.detect_cte('tl', 'titles', 'doc_id', 't')},
{O.detect_cte('bl', 'documents', 'doc_id', 'text')}
SELECT doc_id, tl.detected AS title_lang, bl.detected AS body_lang,
       CASE WHEN coalesce(tl.detected, '') = coalesce(bl.detected, '') THEN coalesce(bl.detected, '') ELSE '' END
           AS source_language,
       coalesce(tl.detected = 'en' AND bl.detected = 'en', false) AS translated
FROM tl JOIN bl USING (doc_id)
""")
def language_agreement(spark, sf_dir):
    """L3: title and body detected separately; the language is kept only when
    they agree, and both English means the article needs no translation."""
    from pressmill.operators import lang
    prof, prior = _lang_model(spark, sf_dir)
    docs = read_table(spark, sf_dir, "documents")
    titles = docs.select("doc_id", F.substring_index("text", "\n", 1).alias("t"))
    tl = lang.detect(titles, prof, prior, "doc_id", "t", out="title_lang")
    bl = lang.detect(docs.select("doc_id", "text"), prof, prior, "doc_id", "text", out="body_lang")
    j = tl.join(bl, "doc_id")
    return j.select("doc_id", "title_lang", "body_lang",
                    lang.agree(F.col("title_lang"), F.col("body_lang")).alias("source_language"),
                    F.coalesce((F.col("title_lang") == "en") & (F.col("body_lang") == "en"),
                               F.lit(False)).alias("translated"))


def _detected_articles(spark, sf_dir):
    from pressmill.operators import lang
    prof, prior = _lang_model(spark, sf_dir)
    arts = derive.articles(spark, sf_dir)
    det = lang.detect(arts.select("id", "body"), prof, prior, "id", "body", out="_det")
    return (arts.join(det, "id")
            .withColumn("source_language", F.coalesce(F.col("_det"), F.lit("und"))).drop("_det")
            .withColumn("translated", F.lit(False))
            .withColumn("translated_title", F.lit(None).cast("string"))
            .withColumn("translated_body", F.lit(None).cast("string")))


_DETECTED_ARTICLES = f"""{O.ARTICLES_CTE}, {O.lang_model_cte()}, {O.detect_cte('det', 'articles', 'id', 'body')},
darts AS (SELECT a.*, coalesce(det.detected, 'und') AS lang FROM articles a JOIN det USING (id))"""


@query("english_passthrough", f"""
WITH {_DETECTED_ARTICLES}
SELECT id, lang AS source_language, lang = 'en' AS translated,
       CASE WHEN lang = 'en' THEN title END AS translated_title,
       CASE WHEN lang = 'en' THEN sha256(body) END AS translated_body_digest
FROM darts
""")
def english_passthrough(spark, sf_dir):
    """L1 + L2: detected English articles carry their originals as translations."""
    from pressmill.operators import lang
    a = lang.english_passthrough(_detected_articles(spark, sf_dir))
    return a.select("id", "source_language", "translated", "translated_title",
                    F.sha2(F.col("translated_body"), 256).alias("translated_body_digest"))


@query("untranslated", f"""
WITH {_DETECTED_ARTICLES}
SELECT id, lang AS source_language FROM darts WHERE lang <> 'en'
""")
def untranslated(spark, sf_dir):
    """L2 + L7: the translation backlog after English pass-through."""
    from pressmill.operators import lang
    a = lang.untranslated(lang.english_passthrough(_detected_articles(spark, sf_dir)))
    return a.select("id", "source_language")


@query("undetermined", f"""
WITH {_DETECTED_ARTICLES}
SELECT id, article_url FROM darts WHERE lang = 'und'
""")
def undetermined(spark, sf_dir):
    """Articles whose language cannot be determined leave the store."""
    from pressmill.operators import lang
    _, dropped = lang.undetermined(_detected_articles(spark, sf_dir))
    return dropped.select("id", "article_url")


# ---------------------------------------------------------------------------
# Translation scatter / gather
# ---------------------------------------------------------------------------
def _memory(spark, sf_dir):
    """Translation memory from earlier runs: every part of the documents whose
    label says quality 1 was translated then (stand-in text ``[xx>en] part``)."""
    from pressmill.operators import translate
    arts = derive.articles(spark, sf_dir)
    labels = read_table(spark, sf_dir, "labels").filter(F.col("quality") == 1).select(F.col("doc_id").alias("id"))
    done = arts.join(labels, "id", "left_semi")
    parts = translate.scatter(done, "id", "source_language")
    return parts.select("source", "text",
                        F.concat(F.lit("["), F.col("source"), F.lit(">en] "), F.col("text")).alias("translated"))


@query("translate_gather", f"""
WITH {O.ARTICLES_CTE},
todo AS (SELECT * FROM articles WHERE NOT translated AND source_language <> 'en'),
{O.parts_cte('tp', 'todo', 'id', 'title', ', source_language')},
{O.parts_cte('bp', 'todo', 'id', 'body', ', source_language')},
good AS (SELECT a.* FROM articles a WHERE a.id IN (SELECT doc_id FROM labels WHERE quality = 1)),
{O.parts_cte('mtp', 'good', 'id', 'title', ', source_language')},
{O.parts_cte('mbp', 'good', 'id', 'body', ', source_language')},
memory AS (
    SELECT * FROM (SELECT DISTINCT source_language AS source, unnest(parts) AS text FROM mtp
                   UNION SELECT DISTINCT source_language, unnest(parts) FROM mbp)
    WHERE trim(text) <> ''),
scat AS (
    SELECT * FROM (
        SELECT id, source_language AS source, 'title' AS field, generate_subscripts(parts, 1) AS part_no,
               unnest(parts) AS text FROM tp
        UNION ALL
        SELECT id, source_language, 'body', generate_subscripts(parts, 1), unnest(parts) FROM bp)
    WHERE trim(text) <> ''),
looked AS (
    SELECT s.id, s.field, s.part_no,
           coalesce(CASE WHEN m.text IS NOT NULL THEN '[' || m.source || '>en] ' || m.text END, '') AS tr
    FROM scat s LEFT JOIN memory m ON m.source = s.source AND m.text = s.text),
g AS (
    SELECT id,
           coalesce(string_agg(CASE WHEN field = 'title' THEN tr END, '' ORDER BY part_no), '') AS tt,
           coalesce(string_agg(CASE WHEN field = 'body' THEN tr END, '' ORDER BY part_no), '') AS tb
    FROM looked GROUP BY id)
SELECT id, length(tb) > 0 AS translated, length(tt) AS title_chars, length(tb) AS body_chars,
       sha256(tt) AS title_digest, sha256(tb) AS body_digest
FROM g
""")
def translate_gather(spark, sf_dir):
    """L6 + J8 + A4: non-English articles cut into parts, looked up in the
    translation memory, and gathered back in order."""
    from pressmill.operators import translate
    arts = derive.articles(spark, sf_dir)
    g = translate.translate_articles(arts, _memory(spark, sf_dir))
    return g.select("id", "translated", F.length("translated_title").alias("title_chars"),
                    F.length("translated_body").alias("body_chars"),
                    F.sha2(F.col("translated_title"), 256).alias("title_digest"),
                    F.sha2(F.col("translated_body"), 256).alias("body_digest"))


# ---------------------------------------------------------------------------
# Enrichment, tags
# ---------------------------------------------------------------------------
@query("keywords_topk", f"""
WITH {O.keywords_cte('kw', 'documents', 'doc_id', 'text', 50)}
SELECT doc_id, term, CAST(round(score, 6) AS DECIMAL(18, 6)) AS score, rank FROM kw
""")
def keywords_topk(spark, sf_dir):
    """A5: the 50 best TF-IDF keywords of every document."""
    from pressmill.operators import enrich
    docs = read_table(spark, sf_dir, "documents")
    kw = enrich.keywords(docs.select("doc_id", "text"), "doc_id", "text", 50)
    # exact decimal output: the compared value never depends on last-bit rounding
    return kw.select("doc_id", "term", F.round("score", 6).cast("decimal(18,6)").alias("score"),
                     F.col("rank").cast("bigint").alias("rank"))


@query("locations", f"""
WITH {O.locations_cte('loc', 'documents', 'doc_id', 'text')}
SELECT doc_id, name, type FROM loc
""")
def locations(spark, sf_dir):
    """Places (countries, cities, regions) the documents mention, longest name at each place."""
    from pressmill.operators import enrich
    docs = read_table(spark, sf_dir, "documents")
    return enrich.locations(docs.select("doc_id", "text"), derive.gazetteer(spark, sf_dir), "doc_id", "text")


def _kw5(spark, sf_dir):
    from pressmill.operators import enrich
    docs = read_table(spark, sf_dir, "documents")
    from pressmill.session import materialize
    # top-5 keyword rows feed several branches (existing / incoming tags): computed once
    return materialize(enrich.keywords(docs.select("doc_id", "text", "lang"), "doc_id", "text", 5)), docs


_KW5 = f"""{O.keywords_cte('kw', 'documents', 'doc_id', 'text', 5)},
bridge AS (SELECT DISTINCT kw.doc_id, {O.slugify('kw.term')} AS slug FROM kw WHERE {O.slugify('kw.term')} <> ''),
named AS (SELECT kw.doc_id, {O.slugify('kw.term')} AS slug, kw.term AS name, d.lang
          FROM kw JOIN documents d USING (doc_id) WHERE {O.slugify('kw.term')} <> '')"""


@query("tag_upsert", f"""
WITH {_KW5},
existing AS (SELECT slug, arg_min(name, doc_id) AS name FROM named WHERE lang = 'en' GROUP BY slug),
incoming AS (SELECT slug, arg_min(name, doc_id) AS name FROM named WHERE lang <> 'en' GROUP BY slug)
SELECT slug, name FROM existing
UNION ALL
SELECT slug, name FROM incoming WHERE slug NOT IN (SELECT slug FROM existing)
""")
def tag_upsert(spark, sf_dir):
    """P13 + J6: tags of English articles exist; keywords of the other
    articles are slugged and only unseen slugs are inserted (first name wins)."""
    from pressmill.operators import enrich
    kw, docs = _kw5(spark, sf_dir)
    rows = enrich.tag_rows(kw, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    existing = (rows.filter(F.col("lang") == "en").groupBy("slug")
                .agg(F.min_by("name", F.col("doc_id")).alias("name")))
    incoming = rows.filter(F.col("lang") != "en").select("doc_id", "slug", "name")
    return enrich.upsert_tags(existing, incoming, order="doc_id")


@query("article_tags", f"""
WITH {_KW5},
tags AS (SELECT slug, arg_min(name, doc_id) AS name FROM named GROUP BY slug)
SELECT b.doc_id, string_agg(t.name, '|' ORDER BY t.name) AS tags, count(*) AS n_tags
FROM bridge b JOIN tags t USING (slug) GROUP BY b.doc_id
""")
def article_tags(spark, sf_dir):
    """E3 + J5: bridge rows (set semantics) and the sorted tag names per article."""
    from pressmill.operators import enrich
    kw, _ = _kw5(spark, sf_dir)
    rows = enrich.tag_rows(kw, "doc_id")
    tags = rows.groupBy("slug").agg(F.min_by("name", F.col("doc_id")).alias("name"))
    names = enrich.tag_names(rows.select("doc_id", "slug"), tags, "doc_id")
    return names.select("doc_id", F.array_join("tags", "|").alias("tags"), F.size("tags").alias("n_tags"))


@query("enrich_record", f"""
WITH {O.ARTICLES_CTE},
gate AS (SELECT id, body FROM articles WHERE translated AND NOT processed),
{O.keywords_cte('kw', 'gate', 'id', 'body', 10)},
{O.locations_cte('loc', 'gate', 'id', 'body')},
places AS (SELECT id, count(*) AS n, '{{"coordinates":[' || string_agg('{{"name":"' || name || '","type":"' || type || '"}}', ','
                                                                       ORDER BY name, type) || ']}}' AS locations
           FROM loc GROUP BY id),
words AS (SELECT id, string_agg(term, ',' ORDER BY rank) AS keywords FROM kw GROUP BY id)
SELECT g.id, coalesce(keywords, '') AS keywords, locations, coalesce(n, 0) AS n_locations, true AS processed
FROM gate g LEFT JOIN words USING (id) LEFT JOIN places USING (id)
""")
def enrich_record(spark, sf_dir):
    """E1 + E2 + E4: translated, unprocessed articles get their keyword and
    location record and are marked processed."""
    from pressmill.operators import enrich
    arts = derive.articles(spark, sf_dir).withColumn("translated_body", F.col("body"))
    gate = enrich.enrichment_gate(arts)
    kw = enrich.keywords(gate.select("id", "body"), "id", "body", 10)
    loc = enrich.locations(gate.select("id", "body"), derive.gazetteer(spark, sf_dir), "id", "body")
    done = gate.select("id", enrich.mark_processed(F.col("translated_body")).alias("processed"))
    return enrich.records(done, kw, loc, "id")


# ---------------------------------------------------------------------------
# Frontier scheduling over saved searches
# ---------------------------------------------------------------------------
_DUE_SQL = f"""active AND (last_processed IS NULL OR TIMESTAMP '{derive.NOW}' - last_processed >
    CASE period WHEN 'hourly' THEN INTERVAL 1 HOUR WHEN 'daily' THEN INTERVAL 1 DAY
                WHEN 'weekly' THEN INTERVAL 7 DAY ELSE INTERVAL 30 DAY END)"""


@query("due_searches", f"""
WITH {O.SEARCHES_CTE}
SELECT id, search_id, period, {O.ts_text('last_processed')} AS last_processed FROM searches WHERE {_DUE_SQL}
""")
def due_searches(spark, sf_dir):
    """active searches never run or whose period has passed (clock = NOW)."""
    s = frontier.due_searches(derive.searches(spark, sf_dir), derive.NOW)
    return s.select("id", "search_id", "period", _ts_text("last_processed").alias("last_processed"))


@query("next_schedule", f"""
WITH {O.SEARCHES_CTE}
SELECT id, {O.ts_text(f"CASE WHEN {_DUE_SQL} THEN TIMESTAMP '{derive.NOW}' ELSE last_processed END")} AS last_processed
FROM searches
""")
def next_schedule(spark, sf_dir):
    """due searches are stamped with the run time, found anything or not."""
    s = frontier.advance_schedule(derive.searches(spark, sf_dir), derive.NOW)
    return s.select("id", _ts_text("last_processed").alias("last_processed"))


@query("search_work", f"""
WITH {O.SEARCHES_CTE}, due AS (SELECT * FROM searches WHERE {_DUE_SQL})
SELECT id AS search_pk, 'engine' AS kind, query AS target, unnest(string_split(source, ', ')) AS engine,
       CAST(search_depth AS BIGINT) AS depth
FROM due WHERE search_type IN ('search_engine', 'simple_search')
UNION ALL SELECT id, 'rss', rss_link, NULL, NULL FROM due WHERE search_type = 'rss'
UNION ALL SELECT id, 'url', article_url, NULL, NULL FROM due WHERE search_type = 'article'
UNION ALL SELECT e.user_id, 'url', 'https://mail.example.org/' || e.event_id, NULL, NULL
          FROM events e JOIN due d ON d.id = e.user_id WHERE d.search_type = 'email' AND e.event_type = 'click'
UNION ALL SELECT e.user_id, 'url', 'https://mail.example.org/' || e.event_id || '/k' || json_extract_string(e.props, '$.k'),
                 NULL, NULL
          FROM events e JOIN due d ON d.id = e.user_id WHERE d.search_type = 'email' AND e.event_type = 'click'
""")
def search_work(spark, sf_dir):
    """F2 + F3 + F4 + F12: due searches routed by type into crawl work; engine
    lists fan out, mailbox JSON flattens to one row per link."""
    w = frontier.search_work(derive.searches(spark, sf_dir), derive.NOW, derive.email_searches(spark, sf_dir))
    return w.select("search_pk", "kind", "target", "engine", "depth")


_ADDRESS_SQL = "CASE engine " + " ".join(f"WHEN '{e}' THEN '{url}'" for e, url, *_ in ENGINE_REQUESTS) + " END"
_PARAMS_SQL = ",\n           ".join(
    f"CASE WHEN engine = '{e}' THEN {value} END" for e, _, fixed, position, count in ENGINE_REQUESTS
    for value in [*(f"'{k}={v}'" for k, v in fixed.items()), *([f"'{position}=' || (base + step * page)"] if position else []),
                  *([f"'{count}=' || (step * d)"] if count else [])])


@query("request_plan", f"""
WITH {O.SEARCHES_CTE}, due AS (SELECT * FROM searches WHERE {_DUE_SQL}),
work AS (SELECT id AS search_pk, query AS target, unnest(string_split(source, ', ')) AS engine,
                search_depth AS depth, exact_terms
         FROM due WHERE search_type IN ('search_engine', 'simple_search')),
spec AS (SELECT * FROM (VALUES {", ".join(f"({O.q(e)}, {O.q(k)}, {s}, {b}, {'NULL' if m is None else m})"
                                          for e, k, s, b, m in __import__('pressmill.schemas', fromlist=['x']).ENGINE_PAGING)})
         AS t(engine, paging, step, base, max_depth)),
j AS (SELECT w.*, s.paging, s.step, s.base, least(coalesce(w.depth, 0), coalesce(s.max_depth, w.depth, 0)) AS d
      FROM work w JOIN spec s USING (engine)),
p AS (SELECT *, unnest(CASE WHEN paging = 'paged' THEN CASE WHEN d > 0 THEN range(0, d) ELSE [] END
                            WHEN paging = 'single' THEN CASE WHEN d > 0 THEN [0] ELSE [] END
                            ELSE [0] END) AS page FROM j)
SELECT search_pk, engine, page, CASE WHEN paging = 'paged' THEN base + step * page END AS start,
       CAST(CASE WHEN paging = 'single' THEN step * d END AS BIGINT) AS size, target AS q,
       CASE WHEN engine = 'google_cse' THEN exact_terms END AS exact_terms,
       {_ADDRESS_SQL} AS address,
       array_to_string(list_sort(list_filter(['q=' || target, {_PARAMS_SQL},
           CASE WHEN engine = 'google_cse' THEN 'exactTerms=' || exact_terms END,
           CASE WHEN engine = 'google_cse' AND exact_terms IS NOT NULL THEN 'excludeTerms=spam' END], lambda x: x IS NOT NULL)), '&') AS request
FROM p
""")
def request_plan(spark, sf_dir):
    """F5 + F6 + F9: engine work -> one request per result page, depth
    clamped per engine, query options merged into the request parameters."""
    w = frontier.search_work(derive.searches(spark, sf_dir), derive.NOW)
    plan = frontier.request_plan(w, frontier.engine_spec(spark))
    return plan.select("search_pk", "engine", F.col("page").cast("bigint").alias("page"),
                       F.col("start").cast("bigint").alias("start"), F.col("size").cast("bigint").alias("size"),
                       F.col("params")["q"].alias("q"), F.col("params")["exactTerms"].alias("exact_terms"), "address",
                       F.array_join(F.array_sort(F.transform(F.map_entries("request"), lambda e: F.concat(
                           e["key"], F.lit("="), e["value"]))), "&").alias("request"))


@query("search_validation", f"""
WITH {O.SEARCHES_CTE}
SELECT id, array_to_string(list_sort(list_distinct(list_filter(string_split(source, ', '),
           lambda x: NOT list_contains({O.sql_list(__import__('pressmill.schemas', fromlist=['x']).SOURCES)}, x)))), ',')
           AS unknown_sources
FROM searches
""")
def search_validation(spark, sf_dir):
    """F8 (+F7): engines named by each search that have no parser."""
    s = derive.searches(spark, sf_dir)
    return s.select("id", F.array_join(F.array_sort(frontier.invalid_sources(F.col("source"))), ",")
                    .alias("unknown_sources"))


@query("engine_errors", f"""
WITH {O.SEARCHES_CTE}, due AS (SELECT * FROM searches WHERE {_DUE_SQL})
SELECT search_pk, engine FROM (
    SELECT id AS search_pk, unnest(string_split(source, ', ')) AS engine
    FROM due WHERE search_type IN ('search_engine', 'simple_search'))
WHERE NOT list_contains({O.sql_list(__import__('pressmill.schemas', fromlist=['x']).SOURCES)}, engine)
""")
def engine_errors(spark, sf_dir):
    """due engine work naming an engine without a parser goes to the error output."""
    w = frontier.search_work(derive.searches(spark, sf_dir), derive.NOW)
    return frontier.engine_errors(w, frontier.engine_spec(spark)).select("search_pk", "engine")


# ---------------------------------------------------------------------------
# Export, ledger, store reads
# ---------------------------------------------------------------------------
def _status_articles(spark, sf_dir):
    arts, searches = _articles_with_search(spark, sf_dir)
    en = arts.withColumn("translated_title", F.when(F.col("translated"), F.col("title"))) \
             .withColumn("translated_body", F.when(F.col("translated"), F.col("body")))
    return triage.assign_status(en, derive.trash_rules(spark), searches), searches


_STATUS_ARTICLES = f"""{O.ARTICLES_CTE}, {O.SEARCHES_CTE},
sa AS (
    SELECT a.*, s.search_id, s.channel AS s_channel,
           {O.initial_status(O.trash_exists('a.article_url', 'a.body'), 's.channel')} AS st
    FROM articles a LEFT JOIN searches s ON a.search_pk = s.id),
sel AS (
    SELECT *, row_number() OVER (ORDER BY post_date_crawled DESC, id) - 1 AS position
    FROM sa WHERE translated AND processed AND NOT pushed
              AND post_date_crawled >= TIMESTAMP '2016-10-04 00:00:00' AND search_id IS NOT NULL)"""


def _batched(spark, sf_dir):
    from pressmill.operators import export
    arts, searches = _status_articles(spark, sf_dir)
    return export.batches(export.export_selection(arts, searches))


@query("export_batches", f"""
WITH {_STATUS_ARTICLES}
SELECT id, position, position // 50 AS batch_id FROM sel
""")
def export_batches(spark, sf_dir):
    """K1 + A8 + O1: the export backlog, newest first, in batches of 50."""
    return _batched(spark, sf_dir).select("id", "position", F.col("batch_id").cast("bigint").alias("batch_id"))


@query("export_payload", f"""
WITH {_STATUS_ARTICLES},
{O.keywords_cte('kw', 'sel', 'id', 'body', 5)},
slugs AS (SELECT DISTINCT id, {O.slugify('term')} AS slug, term FROM kw WHERE {O.slugify('term')} <> ''),
tagged AS (SELECT slug, min(struct_pack(i := id, n := term)).n AS name FROM slugs GROUP BY slug),
tags AS (SELECT id, list(DISTINCT {{'name': name}} ORDER BY {{'name': name}}) AS tags FROM slugs JOIN tagged USING (slug) GROUP BY id),
{O.locations_cte('loc', 'sel', 'id', 'body')},
places AS (SELECT id, {{'coordinates': list({{'name': name, 'type': type}} ORDER BY name, type)}} AS locations FROM loc GROUP BY id)
SELECT id, position // 50 AS batch_id,
       to_json({{'article_url': article_url, 'source_language': source_language, 'title': title,
                'translated_title': CASE WHEN translated THEN title END,
                'body': body, 'translated_body': CASE WHEN translated THEN body END,
                'authors': CASE WHEN id % 5 <> 0 THEN 'Reporter ' || (id % 97) END,
                'post_date_created': {O.ts_text('(post_date_crawled - to_days(CAST(id % 30 AS INTEGER)))')},
                'post_date_crawled': {O.ts_text('post_date_crawled')}, 'translated': translated,
                'top_image_url': CASE WHEN id % 3 = 0 THEN 'https://img.example.org/' || id || '.jpg' ELSE '' END,
                'top_image': CASE WHEN id % 6 = 0 THEN 'article-images/' || id || '.jpg' END,
                'processed': processed, 'search_id': search_id, 'channel': s_channel, 'status': st,
                'locations': locations, 'tags': coalesce(tags, []::STRUCT(name VARCHAR)[])}})::VARCHAR AS payload
FROM sel LEFT JOIN tags USING (id) LEFT JOIN places USING (id)
""")
def export_payload(spark, sf_dir):
    """K2: the transfer document of every exported article, with its tags (E3, J5) and places."""
    from pressmill.operators import enrich, export
    from pressmill.session import materialize
    b = _batched(spark, sf_dir)
    texts = b.select("id", "body")
    kw = materialize(enrich.keywords(texts, "id", "body", 5))
    rows = enrich.tag_rows(kw, "id")
    tags = rows.groupBy("slug").agg(F.min(F.struct("id", "name"))["name"].alias("name"))
    names = enrich.tag_names(rows.select("id", "slug"), tags, "id")
    places = enrich.locations(texts, derive.gazetteer(spark, sf_dir), "id", "body")
    record = enrich.records(b.select("id", "processed"), kw, places, "id").select("id", "locations")
    p = export.payload(derive.with_details(b).join(record, "id"), names)
    return p.select("id", F.col("batch_id").cast("bigint").alias("batch_id"), "payload")


@query("push_ledger", f"""
WITH {_STATUS_ARTICLES},
ledger AS (SELECT id AS article_id FROM sel WHERE position < 50),
rest AS (SELECT s.* FROM sel s WHERE s.id NOT IN (SELECT article_id FROM ledger))
SELECT id, (row_number() OVER (ORDER BY post_date_crawled DESC, id) - 1) // 50 AS batch_id FROM rest
""")
def push_ledger(spark, sf_dir):
    """K4: the previous run pushed one batch and recorded it in the ledger;
    this run anti-joins the ledger and numbers what is left."""
    from pressmill.operators import export
    arts, searches = _status_articles(spark, sf_dir)
    sel = export.export_selection(arts, searches)
    first_run = export.batches(sel, max_batches=1)
    ledger = export.ledger_rows(first_run, derive.NOW)
    second = export.batches(export.unpushed(sel, ledger))
    return second.select("id", F.col("batch_id").cast("bigint").alias("batch_id"))


@query("search_articles_page", f"""
WITH {O.ARTICLES_CTE}, {O.SEARCHES_CTE}
SELECT a.id, a.article_url, a.title, a.source_language
FROM articles a JOIN searches s ON a.search_pk = s.id WHERE s.search_id = 'search-3'
ORDER BY a.id LIMIT 10 OFFSET 10
""")
def search_articles_page(spark, sf_dir):
    """J2 + K3 + O4: page 2 (10 per page) of the articles of search 'search-3'."""
    from pressmill.operators import export
    arts, searches = _articles_with_search(spark, sf_dir)
    a = export.articles_of_search(arts, searches, "search-3")
    return export.page(a, 2).select("id", "article_url", "title", "source_language")


@query("article_by_key", f"""
WITH {O.ARTICLES_CTE},
req AS (SELECT l.doc_id AS request_id, to_base64(encode(a.article_url)) AS key
        FROM labels l JOIN articles a ON a.id = l.doc_id)
SELECT r.request_id, a.id, a.title
FROM req r JOIN articles a ON a.article_url = decode(from_base64(r.key))
""")
def article_by_key(spark, sf_dir):
    """K6 + P9: lookup requests (base64 URL keys, one per labelled document) -> stored articles."""
    from pressmill.operators import export
    arts = derive.articles(spark, sf_dir)
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("request_id"))
    req = labels.join(arts.select(F.col("id").alias("request_id"), "article_url"), "request_id") \
                .select("request_id", ux.encode_key(F.col("article_url")).alias("key"))
    return export.lookup_by_key(arts, req).select("request_id", "id", "title")


@query("article_search", f"""
WITH {O.ARTICLES_CTE}, {O.SEARCHES_CTE}
SELECT a.id FROM articles a JOIN searches s ON a.search_pk = s.id
WHERE a.translated AND NOT a.pushed AND a.article_url ILIKE '%/EN/%' AND s.search_id ILIKE '%SEARCH-1%'
""")
def article_search(spark, sf_dir):
    """Admin list filter (translated, not pushed) + case-insensitive
    contains on the article URL and the search id."""
    from pressmill.operators import export
    arts, searches = _articles_with_search(spark, sf_dir)
    a = arts.join(searches.select(F.col("id").alias("search_pk"), "search_id"), "search_pk")
    return export.admin_search(a, translated=True, pushed=False, url_contains="/EN/",
                               search_contains="SEARCH-1").select("id")


@query("flag_update", f"""
WITH {_STATUS_ARTICLES}
SELECT id, CASE WHEN st = 'trash' THEN false ELSE pushed END AS pushed,
       CASE WHEN st = 'keep' THEN true ELSE processed END AS processed
FROM sa
""")
def flag_update(spark, sf_dir):
    """Bulk actions: trash articles are marked not pushed, kept ones processed."""
    arts, _ = _status_articles(spark, sf_dir)
    a = triage.set_flag(arts, F.col("status") == "trash", "pushed", False)
    a = triage.set_flag(a, F.col("status") == "keep", "processed", True)
    return a.select("id", "pushed", "processed")


@query("quota_admission", """
WITH c AS (
    SELECT event_id, user_id, ts, CAST(floor(value * 100) AS BIGINT) AS volume,
           lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_ts,
           lag(CAST(floor(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_volume
    FROM events)
SELECT event_id, user_id, volume,
       CASE WHEN prev_ts IS NULL THEN NULL ELSE (epoch_us(ts) - epoch_us(prev_ts)) // 1000 END AS gap_ms,
       CASE WHEN prev_ts IS NULL THEN 'FIRST'
            WHEN epoch_us(ts) - epoch_us(prev_ts) >= 120000000 THEN 'TIME'
            WHEN prev_volume <= 2000 THEN 'OK' ELSE 'VOLUME' END AS decision
FROM c
""")
def quota_admission(spark, sf_dir):
    """Every translate-API call (event) admitted or refused by the
    2-minute / 2000-character rule against the same caller's previous call."""
    from pressmill.operators import export
    ev = read_table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"),
        F.floor(F.col("value") * 100).cast("bigint").alias("volume"))
    d = export.quota_decisions(ev, "user_id", "ts", "volume", "event_id")
    return d.select("event_id", "user_id", "volume", F.col("gap_ms").cast("bigint").alias("gap_ms"), "decision")


# ---------------------------------------------------------------------------
# Sources: landed responses derived from pages / conversations, parsed back
# ---------------------------------------------------------------------------
def _pages(spark, sf_dir):
    return read_table(spark, sf_dir, "pages")


_FEED_TS = f"strftime(TIMESTAMP '{derive.FEED_EPOCH}' + to_minutes(CAST(page_id AS BIGINT)) - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S')"


@query("rss_items", f"""
WITH {O.NAV_CTE}
SELECT page_id, 0 AS item_no, {O.strip('url')} AS article_url, {O.strip('title_text')} AS title,
       {O.strip('lead')} AS body, {_FEED_TS} AS post_date_created
FROM nav
UNION ALL
SELECT page_id, k + 1, {O.strip('link')}, {O.strip('text')}, '', {_FEED_TS} FROM links
""")
def rss_items(spark, sf_dir):
    """S1 + S8 + P1 + P2: RSS feeds (CDATA titles, +0100 dates, redirect-wrapped
    news links) parsed into stripped candidates with UTC publication times."""
    from pressmill.sources import feeds
    items = feeds.parse_rss(derive.rss_payloads(_pages(spark, sf_dir)), unwrap_param="url")
    return items.select("page_id", F.col("item_no").cast("bigint").alias("item_no"), "article_url", "title", "body",
                        "post_date_created")


@query("feed_entries", f"""
WITH {O.NAV_CTE},
kinds AS (SELECT * FROM (VALUES (0, 'rss'), (1, 'rdf'), (2, 'atom'), (3, 'rss')) AS k(kind, dialect))
SELECT page_id, dialect, 0 AS item_no, {O.strip('url')} AS article_url, {O.strip('title_text')} AS title,
       {O.strip('lead')} AS body, {_FEED_TS} AS post_date_created
FROM nav JOIN kinds ON kind = page_id % 5
UNION ALL
SELECT page_id, dialect, k + 1, {O.strip('link')}, {O.strip('text')}, '', {_FEED_TS} FROM links JOIN kinds ON kind = page_id % 5
WHERE kind < 3
""")
def feed_entries(spark, sf_dir):
    """Feeds in RSS 2.0, RDF and Atom, and broken ones up to their fault, as stripped candidates."""
    from pressmill.sources import feed_reader
    items = feed_reader.feed_items(feed_reader.read_feeds(derive.feed_payloads(_pages(spark, sf_dir))), unwrap_param="url")
    return items.select("page_id", "dialect", "item_no", "article_url", "title", "body", "post_date_created")


@query("feed_errors", """
SELECT page_id, CASE WHEN page_id % 5 = 3 THEN 'rss' END AS dialect, page_id % 5 = 3 AS is_feed FROM pages WHERE page_id % 5 >= 3
""")
def feed_errors(spark, sf_dir):
    """Feeds that break off and payloads that are none (the message is the XML parser's own)."""
    from pressmill.sources import feed_reader
    e = feed_reader.feed_errors(feed_reader.read_feeds(derive.feed_payloads(_pages(spark, sf_dir))))
    return e.select("page_id", "dialect", F.col("dialect").isNotNull().alias("is_feed"))


@query("cse_results", f"""
WITH {O.NAV_CTE},
complete AS (SELECT host FROM nav GROUP BY host HAVING bool_and(NOT contains(url, '#')))
SELECT page_id, host, k AS item_no, {O.strip('link')} AS article_url, {O.strip('text')} AS title,
       {O.strip('title_text')} AS body
FROM links WHERE host IN (SELECT host FROM complete)
""")
def cse_results(spark, sf_dir):
    """JSON result pages per request (host); a request with any page
    lacking ``items`` yields nothing."""
    from pressmill.sources import feeds
    items = feeds.parse_cse(derive.cse_payloads(_pages(spark, sf_dir)), request="host")
    return items.select("page_id", "host", F.col("item_no").cast("bigint").alias("item_no"),
                        "article_url", "title", "body")


@query("social_posts", f"""
SELECT conv_id, turn, CAST(0 AS BIGINT) AS item_no, 'https://social.example.org/' || conv_id || '/' || turn AS article_url,
       role || ' - @user' || conv_id AS title, {O.strip('text')} AS body
FROM conversations WHERE role <> 'system'
""")
def social_posts(spark, sf_dir):
    """S3: social-search JSON -> (url, 'network - @user', text) candidates."""
    from pressmill.sources import feeds
    posts, _ = feeds.parse_social(derive.social_payloads(read_table(spark, sf_dir, "conversations")))
    return posts.select("conv_id", "turn", F.col("item_no").cast("bigint").alias("item_no"),
                        "article_url", "title", "body")


@query("social_errors", """
SELECT conv_id, turn, 'Social search returned empty result' AS error FROM conversations WHERE role = 'system'
""")
def social_errors(spark, sf_dir):
    """S3 error output: responses without posts."""
    from pressmill.sources import feeds
    _, errors = feeds.parse_social(derive.social_payloads(read_table(spark, sf_dir, "conversations")))
    return errors


@query("xml_results", f"""
WITH {O.NAV_CTE}
SELECT page_id, k AS item_no, {O.strip('link')} AS article_url, {O.strip("text || ' ' || text")} AS title,
       {O.strip('title_text')} AS body
FROM links WHERE NOT contains(url, '#')
""")
def xml_results(spark, sf_dir):
    """XML search responses -> (url, recursive text of title, of passages)."""
    from pressmill.sources import feeds
    items, _, _ = feeds.parse_xml_search(derive.xml_search_payloads(_pages(spark, sf_dir)))
    return items.select("page_id", F.col("item_no").cast("bigint").alias("item_no"), "article_url", "title", "body")


@query("xml_totals", f"""
WITH {O.NAV_CTE}
SELECT page_id, CAST(len(hs) * 7 AS BIGINT) AS found, 'Found ' || (len(hs) * 1000) || ' answers' AS found_human,
       least(len(hs) * 7 / 10.0, 100.0) AS pages
FROM nav WHERE NOT contains(url, '#')
""")
def xml_totals(spark, sf_dir):
    """First ``found`` of each response, its human text and the page count."""
    from pressmill.sources import feeds
    _, totals, _ = feeds.parse_xml_search(derive.xml_search_payloads(_pages(spark, sf_dir)))
    return totals


@query("xml_errors", f"""
WITH {O.NAV_CTE}
SELECT page_id, CAST(15 AS BIGINT) AS code, 'Sorry, there are no results for this search' AS description
FROM nav WHERE contains(url, '#')
""")
def xml_errors(spark, sf_dir):
    """Error envelopes -> (code, description) on the error output."""
    from pressmill.sources import feeds
    _, _, errors = feeds.parse_xml_search(derive.xml_search_payloads(_pages(spark, sf_dir)))
    return errors


@query("html_results", f"""
WITH {O.NAV_CTE}
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'google' ELSE 'bing' END AS engine, k AS item_no,
       {O.strip('link')} AS article_url, {O.strip('text')} AS title,
       {O.strip(O.unescape_html('raw_title'))} AS body
FROM links
""")
def html_results(spark, sf_dir):
    """HTML result pages (google layout with redirect links, bing layout)
    -> candidates, via the selector-driven HTML walk."""
    from pressmill.sources import html_results as hr
    r = hr.parse_html_results(derive.html_result_payloads(_pages(spark, sf_dir)))
    return r.select("page_id", "engine", F.col("item_no").cast("bigint").alias("item_no"),
                    "article_url", "title", "body")


@query("link_files", """
SELECT url AS article_url, CAST(NULL AS BIGINT) AS search_pk FROM pages
""")
def link_files(spark, sf_dir):
    """The page URLs written as a URL-list text file (with blank lines) in
    the shared folder, then read back as candidates without a search."""
    import uuid
    from pressmill.session import checkpoint_dir
    from pressmill.sources import feeds
    path = f"{checkpoint_dir(spark).rstrip('/')}/link-files/{uuid.uuid4().hex}"
    pages = _pages(spark, sf_dir)
    lines = pages.select(F.explode(F.array(F.col("url"), F.lit(""))).alias("value"))
    lines.write.mode("overwrite").text(path)
    return feeds.read_url_lines(spark, path)


# ---------------------------------------------------------------------------
# Page metadata (authors, dates, images) through the tag harvest
# ---------------------------------------------------------------------------
def _page_meta(spark, sf_dir):
    """Metadata of the pages that were fetched as HTML."""
    r = extract.successful(derive.rich_responses(spark, sf_dir))
    r = r.filter(ux.is_html(F.col("content_type")))
    return extract.article_meta(extract.harvest_tags(extract.decoded(r), key_cols=("page_id", "article_url")))


@query("page_meta", f"""
WITH {O.RICH_CTE}
SELECT page_id, authors, post_date_created, top_image_url FROM rich WHERE status < 400 AND is_html
""")
def page_meta(spark, sf_dir):
    """X2-X8 + P15: authors (LD-JSON, meta, itemprop, rel, class precedence),
    publication date (LD-JSON > meta keys > time/span/class tags, through the date
    grammar) and top image, from raw bytes in several charsets."""
    return _page_meta(spark, sf_dir).select("page_id", "authors", "post_date_created", "top_image_url")


@query("image_worklist", f"""
WITH {O.RICH_CTE}
SELECT page_id, top_image_url, lower(regexp_extract(top_image_url, '\\.([A-Za-z0-9]+)$', 1)) AS ext
FROM rich
WHERE status < 400 AND is_html AND regexp_matches(lower(top_image_url), '\\.(jpg|png)$')
""")
def image_worklist(spark, sf_dir):
    """K7 (+X8, P5): pages whose top image (og:image, else first <img>) still
    has to be fetched; ``image_file`` (P10) names where it will be stored."""
    from pressmill.operators import export
    m = _page_meta(spark, sf_dir).withColumn("top_image", F.lit(None).cast("string"))
    w = export.image_worklist(m)
    return w.select("page_id", "top_image_url",
                    F.lower(F.regexp_extract("top_image_url", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"))


@query("scored_content", f"""
WITH {O.PAGE_ARTICLES_CTE}, {O.RICH_CTE}
SELECT page_id, r.article_url, title, body FROM page_art JOIN rich r USING (page_id)
WHERE r.status < 400 AND r.is_html AND length(body) > 0
""")
def scored_content(spark, sf_dir):
    """X1 + P15 + S11: articles of pages that mark none, found by scoring their trees, from raw bytes in several charsets.
    They have to be what the same pages' <article> elements held."""
    r = derive.rich_responses(spark, sf_dir).filter(ux.is_html(F.col("content_type")))
    return extract.page_articles(r, density_fallback=True).select("page_id", "article_url", "title", "body")


@query("rejected_responses", f"""
WITH {O.RICH_CTE}
SELECT page_id, CASE WHEN status >= 400 THEN 'http ' || status ELSE 'no body text' END AS reason
FROM rich WHERE status >= 400 OR NOT is_html
""")
def rejected_responses(spark, sf_dir):
    """S11 + T4: responses that become no article, with the reason."""
    return extract.rejected(derive.rich_responses(spark, sf_dir), "page_id").select("page_id", "reason")


# ---------------------------------------------------------------------------
# Streams (availableNow runs; the sink is returned as a batch DataFrame)
# ---------------------------------------------------------------------------
def _stream(spark, sf_dir, name):
    from pressmill.streaming import jobs
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    return jobs.read_stream(spark, sf_dir, name, schema)


@query("stream_url_dedup", f"""
WITH {O.SEARCHES_CTE},
cand AS (SELECT DISTINCT 'https://news.example.org/item/' || json_extract_string(props, '$.k') AS article_url FROM events)
SELECT article_url FROM cand
WHERE article_url NOT IN (SELECT article_url FROM searches WHERE article_url IS NOT NULL)
""")
def stream_url_dedup(spark, sf_dir):
    """M5 (+F11): URLs named by arriving events, once each, skipping those
    already queued by saved 'article' searches."""
    from pressmill.streaming import jobs
    store = derive.searches(spark, sf_dir).filter(F.col("article_url").isNotNull()).select("article_url")
    cands = jobs.candidate_urls(_stream(spark, sf_dir, "events"))
    return jobs.url_dedup(spark, cands, store).select("article_url")


@query("stream_quota_windows", """
WITH v AS (SELECT time_bucket(INTERVAL 2 MINUTE, ts) AS window_start, user_id,
                  CAST(floor(value * 100) AS BIGINT) AS volume FROM events),
wm AS (SELECT max(ts) - INTERVAL 10 MINUTE AS watermark FROM events)
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, user_id, CAST(sum(volume) AS BIGINT) AS volume,
       count(*) AS calls, sum(volume) > 2000 AS over_limit, window_start + INTERVAL 2 MINUTE <= any_value(watermark) AS final
FROM v, wm GROUP BY window_start, user_id
""")
def stream_quota_windows(spark, sf_dir):
    """M7: translate volume per caller per 2-minute event-time window over all rows, late ones and open windows
    included; ``final`` says whether the watermark (10 minutes) has closed the window."""
    from pressmill.streaming import jobs
    w = jobs.quota_windows(spark, _stream(spark, sf_dir, "events"))
    return w.select(_ts_text("window_start").alias("window_start"), "user_id", "volume", "calls", "over_limit", "final")


@query("stream_email_links", f"""
SELECT event_id AS message_id, user_id AS search_pk, 'https://mail.example.org/' || event_id AS target
FROM events WHERE user_id IN {O.EMAIL_USERS_SQL} AND event_type = 'click'
UNION ALL
SELECT event_id, user_id, 'https://mail.example.org/' || event_id || '/k' || json_extract_string(props, '$.k')
FROM events WHERE user_id IN {O.EMAIL_USERS_SQL} AND event_type = 'click'
""")
def stream_email_links(spark, sf_dir):
    """M4 (+F4): mailbox links of arriving email searches, queued at once."""
    from pressmill.streaming import jobs
    rows = derive.email_searches(spark, sf_dir, events=_stream(spark, sf_dir, "events"))
    return jobs.email_links(spark, rows).select("message_id", "search_pk", "target")


@query("stream_enrich", ORACLES["enrich_record"])
def stream_enrich(spark, sf_dir):
    """M3 (+E1-E4): arriving articles pass the enrichment gate; their keyword and location records are scored against
    the document frequencies of all micro-batches."""
    from pressmill.streaming import jobs
    arts = derive.articles(spark, sf_dir, docs=_stream(spark, sf_dir, "documents"))
    arts = arts.withColumn("translated_body", F.col("body"))
    return jobs.enrich(spark, arts, derive.gazetteer(spark, sf_dir)).select("id", "keywords", "locations", "n_locations", "processed")


@query("stream_export", f"""
WITH {_STATUS_ARTICLES}
SELECT id AS article_id, position // 50 AS batch_id FROM sel
""")
def stream_export(spark, sf_dir):
    """M2 + K1-K4 + M8: exportable articles pushed in batches of 50 per
    micro-batch, recorded in the push ledger (returned)."""
    from pressmill.streaming import jobs
    arts = derive.articles(spark, sf_dir, docs=_stream(spark, sf_dir, "documents"))
    arts = (arts.withColumn("translated_title", F.when(F.col("translated"), F.col("title")))
                .withColumn("translated_body", F.when(F.col("translated"), F.col("body"))))
    searches = derive.searches(spark, sf_dir)
    s = searches.select(F.col("id").alias("_sid"), F.col("channel").alias("_ch"))
    arts = (arts.join(s, arts["search_pk"] == s["_sid"], "left")
            .withColumn("channel", F.col("_ch")).drop("_sid", "_ch"))
    ledger = jobs.export(spark, arts, searches)
    return ledger.select("article_id", F.col("batch_id").cast("bigint").alias("batch_id"))


# ---------------------------------------------------------------------------
# Store maintenance and reads
# ---------------------------------------------------------------------------
@query("store_upsert", f"""
WITH {O.ARTICLES_CTE},
store AS (SELECT arg_min(id, id) AS id, article_url, arg_min(title, id) AS title FROM articles WHERE processed
          GROUP BY article_url),
incoming AS (SELECT id, article_url, title FROM articles
             WHERE article_url NOT IN (SELECT article_url FROM store)),
fresh AS (SELECT article_url, arg_min(id, id) AS id, arg_min(title, id) AS title FROM incoming GROUP BY article_url)
SELECT id, article_url, title FROM store
UNION ALL SELECT id, article_url, title FROM fresh
""")
def store_upsert(spark, sf_dir):
    """K5: processed articles are stored; the whole corpus arrives as a batch;
    only unseen URLs are inserted, each once."""
    from pressmill.operators import export
    arts = derive.articles(spark, sf_dir).select("id", "article_url", "title", "processed")
    store = arts.filter("processed").select("id", "article_url", "title")
    return export.upsert_articles(store, arts.select("id", "article_url", "title"))


@query("search_detail", f"""
WITH {O.SEARCHES_CTE}
SELECT id, search_id, search_type, source, channel, search_depth, active, period
FROM searches WHERE search_id = 'search-7'
""")
def search_detail(spark, sf_dir):
    """K9: one saved search by its search_id."""
    s = derive.searches(spark, sf_dir)
    return s.filter(F.col("search_id") == "search-7").select(
        "id", "search_id", "search_type", "source", "channel", "search_depth", "active", "period")


@query("language_fallback", f"""
WITH {O.lang_model_cte()},
titles AS (SELECT doc_id, split_part(text, chr(10), 1) AS t FROM documents),
{O.detect_cte('tl', 'titles', 'doc_id', 't')},
{O.detect_cte('bl', 'documents', 'doc_id', 'text')},
agreed AS (
    SELECT doc_id, CASE WHEN coalesce(tl.detected, '') = coalesce(bl.detected, '') THEN coalesce(bl.detected, '')
                        ELSE '' END AS lang
    FROM tl JOIN bl USING (doc_id)),
todo AS (SELECT d.doc_id, d.text FROM documents d JOIN agreed a USING (doc_id) WHERE a.lang = ''),
{O.parts_cte('fp', 'todo', 'doc_id', 'text')},
firsts AS (SELECT doc_id, parts[1] AS first_part FROM fp),
{O.detect_cte('fl', 'firsts', 'doc_id', 'first_part')}
SELECT a.doc_id, a.lang AS agreed_language,
       CASE WHEN a.lang = '' THEN fl.detected ELSE a.lang END AS source_language
FROM agreed a LEFT JOIN fl USING (doc_id)
""")
def language_fallback(spark, sf_dir):
    """L3 + L4: where title and body disagree, the language is detected again
    on the first translation part of the body."""
    from pressmill.operators import lang
    prof, prior = _lang_model(spark, sf_dir)
    agreed = language_agreement(spark, sf_dir).select("doc_id", F.col("source_language").alias("agreed_language"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    a = agreed.join(docs, "doc_id").withColumn("source_language", F.col("agreed_language"))
    filled = lang.fill_language(a, prof, prior, key="doc_id", body_col="text")
    return filled.select("doc_id", "agreed_language", "source_language")


@query("article_assembly", f"""
WITH {O.PAGE_ARTICLES_CTE}, {O.RICH_CTE},
arts AS (SELECT p.page_id, r.article_url, p.title, p.body, r.authors, r.post_date_created, r.top_image_url
         FROM page_art p JOIN rich r USING (page_id) WHERE r.status < 400 AND r.is_html AND length(p.body) > 0),
page_text AS (SELECT page_id, {O.untag('body')} AS t FROM arts),
{O.lang_model_cte()}, {O.detect_cte('det', 'page_text', 'page_id', 't')}
SELECT page_id, article_url, title, length(body) AS n_chars, authors, post_date_created, top_image_url, detected AS source_language,
       coalesce(detected = 'en', false) AS translated, {O.initial_status(O.trash_exists('article_url', 'body'), 'NULL')} AS status
FROM arts LEFT JOIN det USING (page_id)
""")
def article_assembly(spark, sf_dir):
    """X9 end to end: raw responses (bytes in several charsets, failed and redirected requests, no marked articles) ->
    article rows with title, cleaned body, authors, publication date, top image, detected language, English
    pass-through and status."""
    from pressmill.plans.assembly import build_articles
    prof, prior = _lang_model(spark, sf_dir)
    a = build_articles(derive.rich_responses(spark, sf_dir), derive.trash_rules(spark), prof, prior)
    return a.select("page_id", "article_url", "title", F.length("body").alias("n_chars"), "authors",
                    "post_date_created", "top_image_url", "source_language", "translated", "status")


_PERIOD_INTERVAL = ("CASE t.period WHEN 'hourly' THEN INTERVAL 1 HOUR WHEN 'daily' THEN INTERVAL 1 DAY "
                    "WHEN 'weekly' THEN INTERVAL 7 DAY ELSE INTERVAL 30 DAY END")


@query("stream_due", f"""
WITH RECURSIVE {O.SEARCHES_CTE},
t AS (
    SELECT e.user_id AS search_pk, e.event_id AS tick_id, e.ts AS tick_ts, s.period,
           row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS rn
    FROM events e LEFT JOIN searches s ON s.id = e.user_id),
g(search_pk, rn, tick_id, last_due, due) AS (
    SELECT search_pk, rn, tick_id, tick_ts, true FROM t WHERE rn = 1
    UNION ALL
    SELECT t.search_pk, t.rn, t.tick_id,
           CASE WHEN t.tick_ts - g.last_due > {_PERIOD_INTERVAL} THEN t.tick_ts ELSE g.last_due END,
           t.tick_ts - g.last_due > {_PERIOD_INTERVAL}
    FROM g JOIN t ON t.search_pk = g.search_pk AND t.rn = g.rn + 1)
SELECT search_pk, tick_id, due FROM g
""")
def stream_due(spark, sf_dir):
    """M1 + M6: every event is a scheduler tick for its user's saved search;
    a stateful stream keeps each search's last run and marks the due ticks
    (checked against a recursive SQL walk, and a plain-Python replay in tests)."""
    from pressmill.streaming import jobs
    ev = _stream(spark, sf_dir, "events")
    periods = derive.searches(spark, sf_dir).select(F.col("id").alias("search_pk"), "period")
    ticks = (ev.select(F.col("user_id").alias("search_pk"), F.col("event_id").alias("tick_id"),
                       F.col("ts").cast("timestamp").alias("tick_ts"))
             .join(periods, "search_pk", "left"))
    return jobs.due_gate(spark, ticks).select("search_pk", "tick_id", "due")
