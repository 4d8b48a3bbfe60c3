"""Declared schemas and fixed values.

No schema inference anywhere: JSON/XML payloads are parsed with the
StructTypes below.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the harvested system's enumerations for
# results to agree; they are stated here as plain text, in their natural order.
# ---------------------------------------------------------------------------
PERIODS = ["hourly", "daily", "weekly", "monthly"]
SEARCH_TYPES = ["simple_search", "search_engine", "rss", "article", "email"]
CHANNELS = ["industry", "research", "government", "other", "search_engines", "social", "general"]
STATUSES = ["keep", "alert", "promoted", "trash", "raw"]
SOURCES = ["google", "google_cse", "google_blogs", "google_news", "google_scholar", "bing", "yandex", "social"]
SOURCE_LABELS = ["Google", "Google CSE", "Google Blogs", "Google News", "Google Scholar", "Bing", "Yandex", "Social"]
SEARCH_TYPE_LABELS = ["Simple Search", "Advanced Search", "RSS Feed", "Article", "Email"]
# channels whose articles start as "keep" (all others, and NULL, start as "raw")
KEEP_CHANNELS = ["industry", "research", "government", "other", "general"]
# entity types kept by the location extractor
LOCATION_TYPES = ["country", "city", "region"]
# characters removed from location names
LOCATION_DELETE_CHARS = "–-—`~!@#$^&*()_+\\|'\":;<>,.?/{}[]=+%0123456789’"
# translation part limit (characters) and export batch size
TRANSLATE_THRESHOLD = 1000
EXPORT_BATCH = 50
SENTENCES_PER_PARAGRAPH = 10
# export only articles crawled on or after this day (UTC)
EXPORT_SINCE = "2016-10-04 00:00:00"
# translate quota: a call is admitted when the previous one was less than
# 2 minutes ago and moved at most 2000 characters
QUOTA_WINDOW_SECONDS = 120
QUOTA_VOLUME = 2000
# per-engine request paging: (engine, kind, step, base, max_depth)
#   kind 'paged'  -> one request per page k, start = base + step * k
#   kind 'single' -> one request, size parameter = step * depth
#   kind 'first'  -> one request for the first page, depth ignored
ENGINE_PAGING = [
    ("google", "paged", 10, 0, None),
    ("google_scholar", "paged", 10, 0, None),
    ("google_blogs", "paged", 10, 0, None),
    ("google_cse", "paged", 10, 1, 10),
    ("bing", "paged", 10, 1, None),
    ("google_news", "single", 10, 0, None),
    ("social", "single", 10, 0, None),
    ("yandex", "first", 0, 0, None),
]
# fixed: where each engine is asked and with which parameters (credentials are the fetcher's):
# (engine, address, fixed parameters, parameter of the position, parameter of the size)
ENGINE_REQUESTS = [
    ("google", "https://google.com/search", {"sa": "N"}, "start", None),
    ("google_scholar", "https://scholar.google.com/scholar", {"sa": "N"}, "start", None),
    ("google_news", "https://news.google.com/news", {"output": "rss"}, None, "num"),
    ("google_cse", "https://www.googleapis.com/customsearch/v1", {"safe": "medium"}, "start", None),
    ("google_blogs", "https://google.com/search", {"tbm": "nws", "tbs": "nrt:b"}, "start", None),
    ("bing", "https://www.bing.com/search", {}, "first", None),
    ("social", "https://api.social-searcher.com/v2/search", {}, None, "limit"),
]
# engines whose requests take the saved search's options
OPTION_ENGINES = ("google_cse",)
# HTML result-page selectors per engine: container class, link/title element,
# snippet element and class, and whether rows lacking link or snippet are skipped.
HTML_ENGINE_SELECTORS = [
    ("google", "div", "g", "span", "st", False),
    ("google_blogs", "div", "g", "div", "st", False),
    ("google_scholar", "div", "gs_ri", "div", "gs_rs", True),
    ("bing", "li", "b_algo", "p", None, False),
]
# meta keys that carry a publication date, in the order they are tried
# (attribute, lower-cased value)
DATE_META_KEYS = [
    ("name", "pubdate"),
    ("name", "publishdate"),
    ("name", "timestamp"),
    ("name", "dc.date.issued"),
    ("property", "article:published_time"),
    ("name", "date"),
    ("property", "bt:pubdate"),
    ("name", "sailthru.date"),
    ("name", "article.published"),
    ("name", "published-date"),
    ("name", "article.created"),
    ("name", "article_date_original"),
    ("name", "cxenseparse:recs:publishtime"),
    ("name", "date_published"),
    ("itemprop", "datepublished"),
    ("itemprop", "datecreated"),
    ("http-equiv", "date"),
]
# class names that mark an element holding a date
DATE_CLASS_PATTERN = "published|pubdate|timestamp|article_date|articledate|date"
# file extensions whose MIME type is an image (the whole URL is tested)
IMAGE_EXTENSIONS = ["bmp", "gif", "ico", "ief", "jpe", "jpeg", "jpg", "png", "svg", "tif", "tiff", "webp",
                    "ras", "pnm", "pbm", "pgm", "ppm", "rgb", "xbm", "xpm", "xwd", "heic", "heif", "avif"]

# ---------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------
LOCATION = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])

ARTICLES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("article_url", T.StringType()),
    T.StructField("source_language", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("translated_title", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("translated_body", T.StringType()),
    T.StructField("authors", T.StringType()),
    T.StructField("post_date_created", T.StringType()),
    T.StructField("post_ts", T.TimestampType()),
    T.StructField("post_date_crawled", T.TimestampType()),
    T.StructField("translated", T.BooleanType()),
    T.StructField("top_image_url", T.StringType()),
    T.StructField("top_image", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("search_pk", T.LongType()),
    T.StructField("processed", T.BooleanType()),
    T.StructField("pushed", T.BooleanType()),
    T.StructField("status", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("locations", T.StructType([T.StructField("coordinates", T.ArrayType(LOCATION))])),
    T.StructField("domains", T.StringType()),
    T.StructField("summary", T.StringType()),
])

SEARCHES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("search_id", T.StringType()),
    T.StructField("search_type", T.StringType()),
    T.StructField("article_url", T.StringType()),
    T.StructField("rss_link", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("search_depth", T.IntegerType()),
    T.StructField("active", T.BooleanType()),
    T.StructField("period", T.StringType()),
    T.StructField("last_processed", T.TimestampType()),
    T.StructField("response_address", T.StringType()),
    T.StructField("options", T.StringType()),
    T.StructField("email_links", T.StringType()),
])

TRASH_FILTERS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("length", T.IntegerType()),
])

CANDIDATE = T.StructType([
    T.StructField("article_url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("post_date_created", T.StringType()),
])

RESPONSES = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("final_url", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("charset", T.StringType()),
    T.StructField("payload", T.StringType()),
])

# JSON search-result payload (one response page)
CSE_PAGE = T.StructType([
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("link", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("htmlTitle", T.StringType()),
        T.StructField("displayLink", T.StringType()),
        T.StructField("mime", T.StringType()),
    ]))),
])

SOCIAL_PAGE = T.StructType([
    T.StructField("posts", T.ArrayType(T.StructType([
        T.StructField("network", T.StringType()),
        T.StructField("posted", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("user", T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("userId", T.StringType()),
            T.StructField("url", T.StringType()),
            T.StructField("image", T.StringType()),
        ])),
    ]))),
    T.StructField("meta", T.StructType([
        T.StructField("http_code", T.IntegerType()),
        T.StructField("limit", T.IntegerType()),
        T.StructField("page", T.IntegerType()),
    ])),
])

# RSS document (root <rss>): channel items
RSS_DOC = "channel STRUCT<item: ARRAY<STRUCT<title: STRING, link: STRING, description: STRING, pubDate: STRING>>>"

# XML search response (root <yandexsearch>)
XML_SEARCH_DOC = (
    "response STRUCT<error: STRUCT<_VALUE: STRING, _code: STRING>, "
    "found: ARRAY<STRUCT<_VALUE: BIGINT, _priority: STRING>>, `found-human`: STRING, "
    "results: STRUCT<grouping: STRUCT<group: ARRAY<STRUCT<doc: ARRAY<STRUCT<"
    "url: STRING, title: STRING, passages: STRING>>>>>>>"
)

OPTIONS = T.MapType(T.StringType(), T.StringType())
EMAIL_LINKS = T.MapType(T.StringType(), T.StructType([T.StructField("links", T.ArrayType(T.StringType()))]))
