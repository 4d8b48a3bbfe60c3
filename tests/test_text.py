"""Segmentation (T1-T8) against plain-Python restatements on the shipped documents."""

import re

import pytest
from pyspark.sql import functions as F

from pressmill.functions import text as tx
from tests.conftest import SF_SMALL


def parts_py(text, threshold=1000):
    """Translation parts: sentences end at words ending in '.', greedy packing."""
    words = text.split()
    sents, cur = [], ""
    for w in words:
        if w.endswith("."):
            sents.append(cur + w)
            cur = ""
        else:
            cur += w + " "
    sents.append(cur)
    out, part = [], ""
    for s in sents:
        if len(part + s + " ") < threshold:
            part += s + " "
        else:
            out.append(part)
            part = s + " "
    out.append(part)
    return out


def groups_py(text, n=10):
    t = text.replace("\n", " ").replace("“", '"').replace("”", '"')
    pieces = re.split(r'(?<=[.!?][\t ")])', t)
    return ["".join(pieces[i:i + n]) for i in range(0, len(pieces), n)]


def tag_p_py(groups):
    out, carry = [], False
    for i, g in enumerate(groups):
        cur = ('"' + g) if carry else g
        close = cur.count('"') % 2 == 1 and not cur.endswith('"')
        out.append(cur + '"' if close else cur)
        carry = close and i < len(groups) - 1
    return "\n".join("<p> " + g + "</p>" for g in out)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")


def test_translation_parts_match_restatement(docs):
    rows = docs.select("doc_id", "text", tx.translation_parts(F.col("text")).alias("p")).collect()
    assert len(rows) >= 200
    for r in rows:
        assert r["p"] == parts_py(r["text"]), r["doc_id"]


def test_parts_edge_cases(spark):
    df = spark.createDataFrame([("",), ("   ",), ("x" * 1200 + ". tail",), ("a. b. c",)], "t string")
    got = [r[0] for r in df.select(tx.translation_parts("t")).collect()]
    assert got == [parts_py(""), parts_py("   "), parts_py("x" * 1200 + ". tail"), parts_py("a. b. c")]
    assert got[0] == [" "]
    assert got[2][0] == ""       # an over-long first sentence closes an empty part


def test_paragraphs_match_restatement(docs):
    rows = docs.select("doc_id", "text", tx.paragraphise(F.col("text")).alias("m")).collect()
    for r in rows:
        assert r["m"] == tag_p_py(groups_py(re.sub(r"<[^>]*>", "", r["text"]))), r["doc_id"]


def test_quote_balancing_hand_cases(spark):
    cases = [['He said "yes. ', 'and left.'], ['"a" b', 'c'], ['x "', 'y "z'], ['odd "one']]
    df = spark.createDataFrame([(c,) for c in cases], "g array<string>")
    got = [r[0] for r in df.select(tx.tag_p("g")).collect()]
    assert got == [tag_p_py(c) for c in cases]
    assert got[0] == '<p> He said "yes. "</p>\n<p> "and left."</p>'


def test_whitespace_markup_cleaning(spark):
    df = spark.createDataFrame([("a  \t b c",), ("English",),
                                ('<p onclick="x()">t</p><script>var a="</p>";</script><!-- c --><style>p{}</style>',)],
                               "t string")
    r = df.select(tx.collapse_ws("t").alias("w"), tx.clean_html("t").alias("c"), tx.strip("t").alias("s")).collect()
    assert r[0]["w"] == "a b c"
    assert r[1]["c"] == "<p>English</p>"
    assert r[2]["c"] == "<p>t</p>"


def test_clean_html_drops_embedded_objects_controls_and_script_addresses(spark):
    cases = {
        '<p>a<iframe src="x">b</iframe>c</p>': "<p>ac</p>",
        '<p>a<embed src="x"/>b<object><param name="q">c</object>d</p>': "<p>abd</p>",
        '<form action="/s"><p>kept</p><input name="q"><button>go</button></form>': "<p>kept</p>",
        '<p><a href="javascript:x()">l</a><a HREF=\' vbscript:y\'>m</a><a href="/java">n</a></p>':
            '<p><a>l</a><a>m</a><a href="/java">n</a></p>',
        "<p>x</p><iframe src='unclosed'><p>y</p>": "<p>x</p><p>y</p>",
        "<p><formula>f</formula><basefont>g</p>": "<p><formula>f</formula><basefont>g</p>",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.c for r in df.select("t", tx.clean_html("t").alias("c")).collect()} == cases
