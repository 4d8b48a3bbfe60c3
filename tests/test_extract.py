"""Page -> article extraction (X1-X9) on inline pages."""

from pyspark.sql import functions as F

from pressmill.operators import extract

PAGE = """<html><head><title>Big &amp; News</title>
<meta name="author" content=" Meta Author ">
<meta property="article:published_time" content="2015-11-25T10:00:00Z">
<meta property="og:image" content="http://img.example/top.jpg">
<script type="application/ld+json">{"author": {"name": "LD Author"}, "datePublished": "2014-01-02"}</script>
</head><body><article><h1>Head</h1><p onclick="x()">Body   text</p><script>bad()</script></article>
<span itemprop="author">Item Author</span><a rel="author" href="/me">Rel Author</a>
<time datetime="2013-05-06">May</time><img src="/first.png"></body></html>"""

NO_LD = """<html><head><title>T</title>
<meta name="DATE_PUBLISHED" content="11/24/2015 01:05AM"></head><body><main><p>x</p></main>
<div class="art-author">Class Author</div></body></html>"""

TAGS_ONLY = """<html><body><p>y</p><time class="timestamp">Thursday, November 26, 2015, 6:42 AM</time></body></html>"""


def _responses(spark, rows):
    return spark.createDataFrame(rows, "url string, final_url string, status int, content_type string, "
                                       "charset string, payload string")


def test_fast_path_title_body(spark):
    r = _responses(spark, [("http://a/", "http://a/final", 200, "text/html", "utf-8", PAGE),
                           ("http://b/", None, 404, "text/html", "utf-8", PAGE)])
    rows = extract.page_articles(r).collect()
    assert len(rows) == 1
    a = rows[0]
    assert a["article_url"] == "http://a/final"          # final URL after redirects
    assert a["title"] == "Big & News"
    assert a["body"] == '<h1>Head</h1><p>Body text</p>'


def test_binary_response_keeps_initial_fields(spark):
    r = _responses(spark, [("http://a/doc.pdf", None, 200, "application/pdf", None, "%PDF")])
    cands = spark.createDataFrame([("http://a/doc.pdf", "Initial", "English", None)],
                                  "article_url string, title string, body string, post_date_created string")
    a = extract.page_articles(r, cands).collect()[0]
    assert (a["title"], a["body"], a["is_html"]) == ("Initial", "<p>English</p>", False)


def test_author_date_image_precedence(spark):
    r = _responses(spark, [("p1", None, 200, "text/html", None, PAGE), ("p2", None, 200, "text/html", None, NO_LD),
                           ("p3", None, 200, "text/html", None, TAGS_ONLY)])
    m = {x["url"]: x for x in extract.article_meta(extract.harvest_tags(r)).collect()}
    # HTML rules override LD-JSON; the later HTML rules override earlier ones
    assert m["p1"]["authors"] == "Rel Author"
    assert m["p2"]["authors"] == "Class Author"
    # LD-JSON date beats meta beats tags
    assert m["p1"]["post_date_created"] == "2014-01-02 00:00:00"
    assert m["p2"]["post_date_created"] == "2015-11-24 01:05:00"
    assert m["p3"]["post_date_created"] == "2015-11-26 06:42:00"
    assert m["p1"]["top_image_url"] == "http://img.example/top.jpg"
    assert m["p3"]["top_image_url"] == ""


def test_parse_date_formats(spark):
    df = spark.createDataFrame([("2015-11-26T07:11:02Z",), ("201511261006",), ("2015-11-25 22:40:25",),
                                ("Thursday, November 26, 2015,  6:42 AM",), ("not a date",)], "s string")
    got = [r[0] for r in df.select(F.date_format(extract.parse_date("s"), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2015-11-26 07:11", "2015-11-26 10:06", "2015-11-25 22:40", "2015-11-26 06:42", None]


def test_density_fallback_only_for_unstructured_pages(spark):
    loose = ("<html><head><title>Loose</title></head><body><div class='nav'><a href='/'>home</a></div>"
             "<div class='content'>The longest block of text on this page wins the body.</div>"
             "<div>short</div></body></html>")
    r = _responses(spark, [("http://l/", None, 200, "text/html", None, loose),
                           ("http://a/", None, 200, "text/html", None, PAGE)])
    rows = {x["url"]: x for x in extract.page_articles(r, density_fallback=True).collect()}
    assert rows["http://l/"]["body"] == "<p>The longest block of text on this page wins the body.</p>"
    assert rows["http://a/"]["body"] == '<h1>Head</h1><p>Body text</p>'


def test_odd_linked_data_does_not_end_the_job(spark):
    from pressmill.operators import extract
    def page(ld):
        return f'<html><script type="application/ld+json">{ld}</script><article>x</article></html>'
    rows = [("a", page('{"author": {"name": ["A. Writer", "B"]}, "datePublished": 20240101}')),
            ("b", page('{"author": {"name": {"x": 1}}, "datePublished": {"y": 2}, "dateCreated": ["2024-01-02"]}'))]
    df = spark.createDataFrame(rows, "url string, payload string")
    out = {r["url"]: r for r in extract.harvest_tags(df).collect()}
    assert (out["a"]["ld_author"], out["a"]["ld_published"]) == ("A. Writer", None)
    assert (out["b"]["ld_author"], out["b"]["ld_created"]) == (None, "2024-01-02")


def test_nested_and_repeated_articles(spark):
    pages = [("http://n/", "<body><article class='x'><p>one</p><article><p>teaser</p></article><p>two</p></article><p>foot</p></body>",
              ["one", "teaser", "two"]),
             ("http://r/", "<body><ARTICLE><p>one</p></ARTICLE><p>between</p><article id=2><p>two</p></article><p>foot</p></body>",
              ["one", "two"]),
             ("http://u/", "<body><article><p>one</p><article><p>two</p></article><p>foot</p></body>", ["one", "two"]),
             ("http://o/", "<body><article><p>one</p></article><p>foot</p></body>", ["one"]),
             ("http://e/", "<body><article><p>one</p><article><p>two</p></body>", ["one", "two"])]
    r = _responses(spark, [(u, None, 200, "text/html", "utf-8", html) for u, html, _ in pages])
    got = {a["article_url"]: a["body"] for a in extract.page_articles(r).collect()}
    for url, _, want in pages:
        assert [w for w in ("one", "teaser", "two", "between", "foot") if w in got[url]] == want
