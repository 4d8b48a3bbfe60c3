"""Text Column functions: strip, whitespace, markup and segmentation.

Every function maps Column -> Column with built-in expressions only, so it
stays inside whole-stage codegen (higher-order functions included). The
order-dependent segmenters (translation parts, quote balancing) use
``aggregate`` over arrays held in one row: the work is per document, never
per group or per table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressmill.schemas import SENTENCES_PER_PARAGRAPH, TRANSLATE_THRESHOLD

def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Inside higher-order-function lambdas Spark re-evaluates every outer
    expression per element (no common-subexpression elimination there), so
    arrays used by a lambda are bound first."""
    return F.get(F.transform(F.array(value), body), 0)


def non_empty(c) -> Column:
    """NULL for NULL or '' (``nullif(c, '')`` without evaluating ``c`` twice)."""
    return let(_c(c), lambda v: F.when(v != "", v))


def strip(c) -> Column:
    """Unicode strip of both ends."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def collapse_ws(c) -> Column:
    """Every run of Unicode whitespace becomes one blank."""
    return F.regexp_replace(_c(c), r"(?U)\s+", " ")


def untag(c) -> Column:
    """Delete everything that looks like a tag."""
    return F.regexp_replace(_c(c), r"<[^>]*>", "")


def unescape_html(c) -> Column:
    """Decode the common named entities (``&amp;`` last)."""
    x = _c(c)
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
                    ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(ent), F.lit(ch))
    return x


_WITH_CONTENT = ["script", "style", "iframe", "object", "applet", "noembed", "select", "textarea", "button"]
_TAG_ONLY = ["iframe", "object", "applet", "embed", "param", "form", "input", "meta", "link", "base"]
#: What clean_html takes out, in this order, as patterns that Java and RE2 read alike.
UNSAFE = [
    r"(?is)<(?:" + "|".join(rf"{t}\b[^>]*>.*?</{t}" for t in _WITH_CONTENT) + r")\s*>",
    r"(?s)<!--.*?-->",
    r"(?is)</?(?:" + "|".join(_TAG_ONLY) + r")(?:[\s/][^>]*)?>",
    r"""(?i)\s+on[a-z]+\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""",
    r"""(?i)\s+(?:href|src|action|background)\s*=\s*("\s*(?:java|vb)script:[^"]*"|'\s*(?:java|vb)script:[^']*'|(?:java|vb)script:[^\s>]+)""",
]


def clean_html(c) -> Column:
    """Drop scripts, styles, comments, embedded objects, form controls (a form's text stays), page metadata, inline
    event handlers and script addresses; bare text (no element at all) is wrapped in one paragraph."""
    x = _c(c)
    for pattern in UNSAFE:
        x = F.regexp_replace(x, pattern, "")
    # bound once: the branches below would otherwise each re-run the chain
    return let(x, lambda v: F.when(v.rlike(r"<[A-Za-z]"), v).otherwise(F.concat(F.lit("<p>"), v, F.lit("</p>"))))


def word_list(c) -> Column:
    """Python ``str.split()``: Unicode whitespace runs, no empty words."""
    return F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: w != "")


def sentences_for_parts(c) -> Column:
    """T5 step 1: sentences as the translation chunker sees them.

    A sentence ends only at a word ending in '.'; words are re-joined by one
    blank; the unfinished tail (or '' after a final '.') is the last element.
    """
    def with_joined(joined):
        # a blank preceded by '.' is exactly "a word ending in '.' followed by a word"
        def with_pieces(pieces):
            n = F.size(pieces)
            return F.when(F.length(joined) == 0, F.array(F.lit(""))).when(
                F.endswith(joined, F.lit(".")), F.array_append(pieces, F.lit(""))
            ).otherwise(
                F.concat(F.slice(pieces, 1, n - 1),
                         F.array(F.concat(F.element_at(pieces, n), F.lit(" "))))
            )
        return let(F.split(joined, r"(?<=\.) ", -1), with_pieces)

    return let(F.array_join(word_list(c), " "), with_joined)


def translation_parts(c, threshold: int = TRANSLATE_THRESHOLD) -> Column:
    """T5: greedy packing of sentences into parts shorter than ``threshold``.

    A sentence is added while ``len(part + sentence + ' ') < threshold``;
    otherwise the part is closed and the sentence starts the next one. Long
    sentences are never cut; an over-long first sentence closes an empty part.
    """
    sents = sentences_for_parts(c)
    init = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(acc, s):
        fits = F.length(acc["cur"]) + F.length(s) + 1 < threshold
        return F.struct(
            F.when(fits, acc["out"]).otherwise(F.array_append(acc["out"], acc["cur"])).alias("out"),
            F.when(fits, F.concat(acc["cur"], s, F.lit(" "))).otherwise(F.concat(s, F.lit(" "))).alias("cur"),
        )

    return F.aggregate(sents, init, step, lambda acc: F.array_append(acc["out"], acc["cur"]))


def sentence_pieces(c) -> Column:
    """T6 step 1: newlines to blanks, curly to straight double quotes, then
    split after every ``[.!?]+`` followed by tab, blank, '"' or ')'. Each
    piece keeps its own delimiter; the count equals a plain regex split."""
    x = F.regexp_replace(_c(c), "\n", " ")
    x = F.regexp_replace(x, "[“”]", '"')
    return F.split(x, r'(?<=[.!?][\t ")])', -1)


def sentence_groups(c, per_group: int = SENTENCES_PER_PARAGRAPH) -> Column:
    """Glue every ``per_group`` consecutive pieces into one group."""
    def body(pieces):
        n_groups = F.floor((F.size(pieces) + (per_group - 1)) / per_group).cast("int")
        return F.transform(
            F.sequence(F.lit(0), n_groups - 1),
            lambda k: F.array_join(F.slice(pieces, k * per_group + 1, per_group), ""),
        )
    return let(sentence_pieces(c), body)


def _quote_count(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit('"'), F.lit("")))


def balance_quotes(groups) -> Column:
    """T7 step 1: a group with an odd number of '"' that does not end in '"'
    is closed with '"', and the next group is opened with '"'."""
    def body(g):
        n = F.size(g)
        init = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("carry"))

        def step(acc, x):
            def with_cur(cur):
                close = ((_quote_count(cur) % 2) == 1) & ~F.endswith(cur, F.lit('"'))
                is_last = F.size(acc["out"]) == n - 1
                return F.struct(
                    F.array_append(acc["out"], F.when(close, F.concat(cur, F.lit('"'))).otherwise(cur)).alias("out"),
                    (close & ~is_last).alias("carry"),
                )
            return let(F.when(acc["carry"], F.concat(F.lit('"'), x)).otherwise(x), with_cur)

        return F.aggregate(g, init, step, lambda acc: acc["out"])
    return let(_c(groups), body)


def tag_p(groups) -> Column:
    """Balance quotes, wrap each group as ``<p> group</p>``, join by newline."""
    return F.array_join(
        F.transform(balance_quotes(groups), lambda s: F.concat(F.lit("<p> "), s, F.lit("</p>"))), "\n")


def paragraphise(c) -> Column:
    """Untag, split into sentence groups, mark up paragraphs."""
    return tag_p(sentence_groups(untag(c)))
