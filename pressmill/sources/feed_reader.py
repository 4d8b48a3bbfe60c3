"""Feeds of any dialect -> candidates and errors.

One streaming pass of a namespace-aware XML parser per payload reads RSS 2.0 (and 0.9x), RSS 1.0 (RDF)
and Atom alike: an entry is an ``item`` or ``entry`` element, its fields are told by namespace and name. What stands before a
fault in a broken feed is kept, and the fault becomes a row of the error output; so does a payload
that is no feed. Payloads may be text or bytes (the XML declaration then tells the charset).
"""

from __future__ import annotations

from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.functions import text as tx
from pressmill.functions.dates import parse_date
from pressmill.functions.urls import unwrap_redirect

#: Fixed: namespaces of the dialects and of the modules whose fields count.
ATOM, RSS1, RSS09 = "http://www.w3.org/2005/Atom", "http://purl.org/rss/1.0/", "http://my.netscape.com/rdf/simple/0.9/"
DC, CONTENT, RDF = "http://purl.org/dc/elements/1.1/", "http://purl.org/rss/1.0/modules/content/", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
#: Fixed: the elements that give each field, the preferred one first.
FIELDS = {
    "title": [("", "title"), (RSS1, "title"), (RSS09, "title"), (ATOM, "title"), (DC, "title")],
    "link": [("", "link"), (RSS1, "link"), (RSS09, "link"), ("", "guid")],
    "description": [("", "description"), (RSS1, "description"), (ATOM, "summary"), (CONTENT, "encoded"), (ATOM, "content")],
    "published": [("", "pubDate"), (ATOM, "published"), (DC, "date"), (ATOM, "updated")],
}
ROOTS = {("", "rss"): "rss", (RDF, "RDF"): "rdf", (ATOM, "feed"): "atom"}
ENTRIES = {("", "item"), (RSS1, "item"), (RSS09, "item"), (ATOM, "entry")}
_KNOWN = {name for names in FIELDS.values() for name in names}


class _Reader:
    def __init__(self):
        self.dialect, self.items = None, []
        self.depth, self.entry_depth, self.entry = 0, 0, None
        self.field = self.field_depth = None
        self.text: list[str] = []

    def start(self, name, attrs):
        self.depth += 1
        space, _, local = name.rpartition(" ")
        here = (space, local)
        if self.depth == 1:
            self.dialect = ROOTS.get(here)
        elif self.entry is None:
            if here in ENTRIES:
                self.entry, self.entry_depth = {}, self.depth
        elif self.field is None and self.depth == self.entry_depth + 1:
            if here == (ATOM, "link"):
                # the page itself: no relation, or "alternate"; the first one counts
                if attrs.get("rel", "alternate") == "alternate":
                    self.entry.setdefault(("", "link"), attrs.get("href", ""))
            elif here in _KNOWN:
                self.field, self.field_depth, self.text = here, self.depth, []

    def data(self, data):
        if self.field is not None:
            self.text.append(data)

    def end(self, name):
        if self.field is not None and self.depth == self.field_depth:
            self.entry.setdefault(self.field, "".join(self.text))
            self.field = None
        elif self.entry is not None and self.depth == self.entry_depth:
            self.items.append({f: next((self.entry[n] for n in names if self.entry.get(n)), None) for f, names in FIELDS.items()})
            self.entry = None
        self.depth -= 1


def read_feed(payload: str | bytes | None) -> tuple[str | None, list[dict], str | None]:
    """Dialect, items (title, link, description, published) and the error, if there is one."""
    if not payload or not payload.strip():
        return None, [], "empty payload"
    # text has been decoded already, whatever its declaration says
    parser = expat.ParserCreate("utf-8" if isinstance(payload, str) else None, namespace_separator=" ")
    parser.buffer_text = True
    reader = _Reader()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = reader.start, reader.end, reader.data
    fault = None
    try:
        parser.Parse(payload.lstrip() if isinstance(payload, bytes) else payload.lstrip().encode("utf-8", "replace"), True)
    except expat.ExpatError as e:
        fault = str(e)
    except (LookupError, ValueError) as e:  # a charset that nothing knows
        fault = f"{type(e).__name__}: {e}"
    if reader.dialect is None:
        return None, [], fault or "not a feed"
    return reader.dialect, reader.items, fault


def read_feeds(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The keys of ``df`` with dialect, item_no, title, link, description, published, error: a row per item, and one with
    ``error`` (and no item) per feed that is broken or none."""
    keys = [c for c in df.columns if c != payload]

    def run(batches):
        for b in batches:
            at, rows = [], []
            for n, text in enumerate(b.column(len(keys)).to_pylist()):
                dialect, items, fault = read_feed(text)
                found = [(dialect, i, x["title"], x["link"], x["description"], x["published"], None) for i, x in enumerate(items)]
                found += [(dialect, None, None, None, None, None, fault)] if fault else []
                at += [n] * len(found)
                rows += found
            cells = list(zip(*rows)) or [()] * 7
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(k).take(take) for k in range(len(keys))]
                + [pa.array(c, pa.int32() if k == 1 else pa.string()) for k, c in enumerate(cells)],
                names=keys + ["dialect", "item_no", "title", "link", "description", "published", "error"])

    given = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, payload).mapInArrow(
        run, f"{given}, dialect string, item_no int, title string, link string, description string, published string, error string")


def feed_items(read: DataFrame, unwrap_param: str | None = None, anchor: Column | None = None) -> DataFrame:
    """Candidates from ``read_feeds``: keys, dialect, item_no, article_url, title, body, post_date_created (UTC), post_ts."""
    from pressmill.sources.feeds import candidate
    keys = read.columns[:read.columns.index("dialect")]
    link = unwrap_redirect(F.col("link"), unwrap_param) if unwrap_param else F.col("link")
    items = read.where("item_no IS NOT NULL").withColumn("post_ts", parse_date("published", anchor))
    return items.select(*keys, "dialect", "item_no",
                        *candidate(F.coalesce(link, F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))),
                        F.date_format("post_ts", "yyyy-MM-dd HH:mm:ss").alias("post_date_created"), "post_ts")


def feed_errors(read: DataFrame) -> DataFrame:
    """Keys, dialect and error of feeds that are broken or none."""
    keys = read.columns[:read.columns.index("dialect")]
    return read.where("error IS NOT NULL").select(*keys, "dialect", tx.strip(F.col("error")).alias("error"))


def read_feed_files(spark: SparkSession, path: str) -> DataFrame:
    """``read_feeds`` over files, one feed each: path and the rest."""
    files = spark.read.format("binaryFile").load(path)
    return read_feeds(files.select("path", F.col("content").alias("payload")))
