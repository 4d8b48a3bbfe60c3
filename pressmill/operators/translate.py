"""Translation scatter/gather against a translation memory.

Scatter: every untranslated article's title and body are cut into parts
(T5) and exploded with their position. Lookup: parts join the memory on
(source language, text); a part the memory cannot serve translates to ''.
Gather: parts are re-assembled per (article, field) in position order; the
article counts as translated once its body is non-empty.

The lookup is a shuffle join (the memory grows with the corpus: never
broadcast); AQE's skew handling splits boiler-plate parts that repeat across
many articles. The gather groups by article, whose size is bounded by the
article's own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.functions import text as tx


def scatter(articles: DataFrame, key: str = "id", lang_col: str = "source_language") -> DataFrame:
    """(key, source, field, part_no, text) for the non-blank title and body
    parts; ``part_no`` is the position among all parts."""
    fields = F.array(
        F.struct(F.lit("title").alias("field"), tx.translation_parts(F.col("title")).alias("parts")),
        F.struct(F.lit("body").alias("field"), tx.translation_parts(F.col("body")).alias("parts")),
    )
    f = articles.select(F.col(key), F.col(lang_col).alias("source"), F.explode(fields).alias("f"))
    parts = f.select(key, "source", F.col("f.field").alias("field"),
                     F.posexplode(F.col("f.parts")).alias("part_no", "text"))
    # blank parts (an over-long first sentence, the closing tail) carry no text
    return parts.filter(F.length(F.trim(F.col("text"))) > 0)


def lookup(parts: DataFrame, memory: DataFrame) -> DataFrame:
    """Translated text per part ('' when the memory has none)."""
    m = memory.select("source", "text", F.col("translated").alias("_tr")).dropDuplicates(["source", "text"])
    return (parts.join(m, ["source", "text"], "left")
            .withColumn("translated", F.coalesce(F.col("_tr"), F.lit(""))).drop("_tr"))


def gather(parts: DataFrame, key: str = "id") -> DataFrame:
    """A4: ordered concatenation per (key, field), pivoted to title/body."""
    g = parts.groupBy(key).agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.when(F.col("field") == "title", F.struct("part_no", "translated")))),
            lambda x: x["translated"]), "").alias("translated_title"),
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.when(F.col("field") == "body", F.struct("part_no", "translated")))),
            lambda x: x["translated"]), "").alias("translated_body"),
    )
    return g.withColumn("translated", F.length("translated_body") > 0)


def translate_articles(articles: DataFrame, memory: DataFrame, key: str = "id",
                       lang_col: str = "source_language") -> DataFrame:
    """Untranslated, non-English articles -> translated title/body."""
    todo = articles.filter(~F.coalesce(F.col("translated"), F.lit(False)) &
                           F.coalesce(F.col(lang_col) != "en", F.lit(True)))
    return gather(lookup(scatter(todo, key, lang_col), memory), key)
