"""Landed responses -> stored-article rows, composed from the operators.

responses -> S11 (success, final URL) -> P6 (HTML?) -> X1 (title/body, density
fallback only where needed) -> T3/T1/T4 (clean, collapse, drop empty) ->
X2-X8 (authors, date, image from one harvest pass) -> L1 (language on the
body text) -> L2 (English pass-through) -> J1 (search: channel) -> G2/G4
(status). Only the harvest step runs Python; the HTML column is dropped right
after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.functions import text as tx
from pressmill.operators import extract, lang, triage
from pressmill.session import materialize


def build_articles(responses: DataFrame, rules: DataFrame, profile: DataFrame, prior: DataFrame,
                   key: str = "page_id", candidates: DataFrame | None = None,
                   searches: DataFrame | None = None, search_pk: DataFrame | None = None) -> DataFrame:
    arts = extract.page_articles(responses, candidates, density_fallback=True)
    # a table of pages that are all fetched has no crawl time; relative dates then have nothing to go by
    crawled = "crawled_at" in responses.columns
    harvest = extract.harvest_tags(extract.decoded(extract.successful(responses)),
                                   key_cols=(key, "crawled_at") if crawled else (key,))
    meta = extract.article_meta(harvest, F.col("crawled_at") if crawled else None)
    arts = arts.join(meta.select(key, "authors", "post_date_created", "post_ts", "top_image_url"), key, "left")
    # the extracted rows (HTML gone) feed several branches below: cut the
    # lineage once so the Python harvest never runs again for them
    arts = materialize(arts)
    det = lang.detect(arts.select(key, tx.untag(F.col("body")).alias("_t")), profile, prior, key, "_t",
                      out="source_language")
    arts = (arts.join(det, key, "left")
            .withColumn("translated_title", F.lit(None).cast("string"))
            .withColumn("translated_body", F.lit(None).cast("string"))
            .withColumn("translated", F.lit(False)))
    arts = lang.english_passthrough(arts)
    if search_pk is not None:
        arts = arts.join(search_pk, key, "left")
    else:
        arts = arts.withColumn("search_pk", F.lit(None).cast("bigint"))
    arts = arts.withColumn("status", F.when(~F.col("is_html"), F.lit("trash"))).withColumn(
        "channel", F.lit(None).cast("string"))
    return triage.assign_status(arts, rules, searches)
