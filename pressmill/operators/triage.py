"""Rule-based triage: trash rules (J3) and article status.

A trash rule is (url regex, text regex, max length). An article is trash when
any rule matches:

    url matches (or the article has no url)
    AND (body is NULL or '' OR (text matches AND (length = 0 OR len(body) <= length)))

The rule table is an admin-entered parameter. Its rows become literal
conditions, so Spark compiles each pattern once and the articles are read in one
pass, without a join. Patterns should stay in the regex subset shared by Java and
RE2 (no look-around, no back-references).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.schemas import KEEP_CHANNELS


def rule_list(rules: DataFrame) -> list[tuple]:
    """(id, url pattern, text pattern, length) of every rule; NULLs match all."""
    return [(r["id"], r["url"] if r["url"] is not None else ".", r["text"] if r["text"] is not None else ".",
             r["length"] or 0) for r in rules.select("id", "url", "text", "length").collect()]


def rule_matches(rule: tuple, url: Column, body: Column) -> Column:
    """Boolean test of one rule, never NULL."""
    _, url_pattern, text_pattern, length = rule
    url_ok = url.isNull() | F.coalesce(url.rlike(url_pattern), F.lit(False))
    text_ok = F.coalesce(body.rlike(text_pattern), F.lit(False))
    if length:
        text_ok = text_ok & (F.length(body) <= length)
    return url_ok & (body.isNull() | (body == "") | text_ok)


def _any(conditions: list[Column]) -> Column:
    """A balanced OR, so that many rules make no deep expression."""
    if not conditions:
        return F.lit(False)
    while len(conditions) > 1:
        conditions = [reduce(lambda a, b: a | b, conditions[i:i + 2]) for i in range(0, len(conditions), 2)]
    return conditions[0]


def mark_trash(articles: DataFrame, rules: DataFrame, url_col: str = "article_url",
               body_col: str = "body", out: str = "is_trash") -> DataFrame:
    """Adds boolean ``out`` (any rule matches) to every article."""
    return articles.withColumn(out, _any([rule_matches(r, F.col(url_col), F.col(body_col)) for r in rule_list(rules)]))


def trash_hits(articles: DataFrame, rules: DataFrame, key: str = "id", url_col: str = "article_url",
               body_col: str = "body") -> DataFrame:
    """Which rule matched which article: (key, rule_id) pairs for every match."""
    kind = rules.schema["id"].dataType
    hits = [F.when(rule_matches(r, F.col(url_col), F.col(body_col)), F.lit(r[0]).cast(kind)) for r in rule_list(rules)]
    found = F.array_compact(F.array(*hits)) if hits else F.array().cast(f"array<{kind.simpleString()}>")
    return articles.select(key, found.alias("_hits")).select(key, F.explode("_hits").alias("rule_id"))


def initial_status(is_trash: Column, channel: Column) -> Column:
    """G1: trash beats keep (curated channels) beats raw (everything else, NULL too)."""
    return (F.when(is_trash, F.lit("trash"))
            .when(channel.isin(*KEEP_CHANNELS), F.lit("keep"))
            .otherwise(F.lit("raw")))


def assign_status(articles: DataFrame, rules: DataFrame, searches: DataFrame | None = None,
                  search_key: str = "search_pk") -> DataFrame:
    """On save, the channel comes from the article's search (when it has
    one) and a missing status is set to the initial status."""
    a = articles
    if searches is not None:
        s = searches.select(F.col("id").alias("_sid"), F.col("channel").alias("_search_channel"))
        a = a.join(s, a[search_key] == s["_sid"], "left")
        a = (a.withColumn("channel", F.when(F.col("_sid").isNotNull(), F.col("_search_channel"))
                          .otherwise(F.col("channel")))
             .drop("_sid", "_search_channel"))
    a = mark_trash(a, rules, out="_is_trash")
    return (a.withColumn("status", F.coalesce(F.col("status"), initial_status(F.col("_is_trash"), F.col("channel"))))
            .drop("_is_trash"))


def status_changes(articles: DataFrame, rules: DataFrame) -> DataFrame:
    """Recompute the initial status; emit only rows whose status changes."""
    a = mark_trash(articles, rules, out="_is_trash")
    a = a.withColumn("new_status", initial_status(F.col("_is_trash"), F.col("channel"))).drop("_is_trash")
    return a.filter(~F.col("status").eqNullSafe(F.col("new_status")))


def binary_to_trash(status: Column, html: Column) -> Column:
    """A non-HTML response is trash."""
    return F.when(~html, F.lit("trash")).otherwise(status)


def set_flag(df: DataFrame, selected: Column, flag: str, value: bool) -> DataFrame:
    """Bulk flag update on a selection."""
    return df.withColumn(flag, F.when(selected, F.lit(value)).otherwise(F.col(flag)))
