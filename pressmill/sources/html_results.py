"""HTML search-result pages -> candidates.

One ``mapInPandas`` pass over the tolerant tree of ``functions/htmltree.py``, driven by the
per-engine selector table (container element/class, snippet element/class).
For each result container it takes the first link's href and text and the
first snippet element's text ('' when missing). The Python step only walks
markup; redirect unwrapping and stripping run as Spark expressions after it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill.functions import htmltree
from pressmill.functions import text as tx
from pressmill.functions.urls import unwrap_redirect
from pressmill.schemas import HTML_ENGINE_SELECTORS
from pressmill.session import small_batches

_SEL = {e: (ct, cc, st, sc, skip) for e, ct, cc, st, sc, skip in HTML_ENGINE_SELECTORS}
# google-family result links are wrapped by a redirector (parameter q)
_UNWRAP = ["google", "google_blogs", "google_scholar"]

RESULT_SCHEMA = T.StructType([
    T.StructField("item_no", T.IntegerType()),
    T.StructField("href", T.StringType()),
    T.StructField("link_text", T.StringType()),
    T.StructField("snippet", T.StringType()),
])


def parse_result_page(engine: str, html: str | None) -> list[tuple]:
    """(item_no, href, link text, snippet) per result container, in document order. A container's first link and first
    snippet element count, wherever they stand in it; a result within another one is a result of its own."""
    sel = _SEL.get(engine)
    if sel is None or not html:
        return []
    ctag, cclass, stag, sclass, skip = sel
    out = []
    root = htmltree.parse(html)
    for box in root.nodes():
        # div containers match the class exactly, li containers by contains
        cls = box.attrs.get("class", "")
        if box.tag != ctag or not (cls == cclass if ctag == "div" else cclass in cls):
            continue
        inside = list(box.nodes())[1:]
        link = next((n for n in inside if n.tag == "a" and "href" in n.attrs), None)
        snippet = next((n for n in inside if n.tag == stag and (sclass is None or n.attrs.get("class", "") == sclass)), None)
        if skip and (link is None or snippet is None):
            continue
        out.append((len(out), link.attrs["href"] if link is not None else "", link.text() if link is not None else "",
                    snippet.text() if snippet is not None else ""))
    root.release()
    return out


def _batches(it, keys):
    for pdf in it:
        rows = []
        for rec in pdf.itertuples(index=False):
            d = rec._asdict()
            for item in parse_result_page(d["engine"], d["payload"]):
                rows.append([d[k] for k in keys] + list(item))
        yield pd.DataFrame(rows, columns=keys + RESULT_SCHEMA.fieldNames())


def parse_html_results(df: DataFrame, engine: str = "engine", payload: str = "payload") -> DataFrame:
    """(keys..., item_no, article_url, title, body) per result."""
    keys = [c for c in df.columns if c != payload]
    if engine not in keys:
        raise ValueError("the engine column is required")
    schema = T.StructType([df.schema[k] for k in keys] + RESULT_SCHEMA.fields)
    small_batches(df.sparkSession)
    raw = df.select(*keys, payload).mapInPandas(lambda it: _batches(it, keys), schema)
    href = F.when(F.col(engine).isin(*_UNWRAP), unwrap_redirect(F.col("href"), "q")).otherwise(F.col("href"))
    return raw.select(*keys, "item_no", tx.strip(href).alias("article_url"), tx.strip(F.col("link_text")).alias("title"),
                      tx.strip(F.col("snippet")).alias("body"))
