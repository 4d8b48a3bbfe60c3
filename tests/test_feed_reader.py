from pyspark.sql import functions as F

from pressmill.sources import feed_reader as fr

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>C</title><link>http://c/</link>
<item><title><![CDATA[A & B]]></title><link> http://a/1 </link><description>x &lt;b&gt;y&lt;/b&gt;</description>
<pubDate>Thu, 26 Nov 2015 13:48:30 +0100</pubDate></item>
<item><title>two</title><guid>http://a/2</guid><dc:date>2015-11-26T01:00:00Z</dc:date><image><title>no</title></image></item></channel></rss>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:d="http://purl.org/dc/elements/1.1/">
<channel rdf:about="http://c/"><title>C</title></channel><item rdf:about="http://r/1"><title>R</title><link>http://r/1</link>
<description>d</description><d:date>2015-11-26T10:00+02:00</d:date></item></rdf:RDF>"""
ATOM = """<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:title>C</a:title><a:entry><a:title type="html">T</a:title>
<a:link rel="self" href="http://s/"/><a:link href="http://t/1"/><a:link href="http://t/2"/><a:updated>2015-11-27T00:00:00Z</a:updated>
<a:published>2015-11-26T00:00:00-01:00</a:published><a:content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml">in <b>bold</b></div></a:content>
</a:entry></a:feed>"""


def test_three_dialects():
    dialect, items, fault = fr.read_feed(RSS)
    assert (dialect, fault) == ("rss", None)
    assert items[0] == {"title": "A & B", "link": " http://a/1 ", "description": "x <b>y</b>", "published": "Thu, 26 Nov 2015 13:48:30 +0100"}
    assert items[1] == {"title": "two", "link": "http://a/2", "description": None, "published": "2015-11-26T01:00:00Z"}
    assert fr.read_feed(RDF) == ("rdf", [{"title": "R", "link": "http://r/1", "description": "d", "published": "2015-11-26T10:00+02:00"}], None)
    assert fr.read_feed(ATOM) == ("atom", [{"title": "T", "link": "http://t/1", "description": "in bold",
                                            "published": "2015-11-26T00:00:00-01:00"}], None)
    latin = '<?xml version="1.0" encoding="iso-8859-1"?><rss><channel><item><title>né</title></item></channel></rss>'
    assert fr.read_feed(latin.encode("latin-1"))[1][0]["title"] == fr.read_feed(latin)[1][0]["title"] == "né"


def test_items_before_a_fault_are_kept_and_faults_have_rows(spark):
    cut = RSS[:RSS.index("<item><title>two")]
    feeds = [(1, RSS), (2, RDF), (3, ATOM), (4, cut), (5, "<html><body>x</body></html>"), (6, ""), (7, None), (8, "no xml"),
             (9, '<rss><channel></channel></rss>'), (10, "<rss><channel><item><title>&nbsp;</title></item></channel></rss>")]
    read = fr.read_feeds(spark.createDataFrame(feeds, "id long, payload string"))
    items = sorted((r.id, r.dialect, r.item_no, r.article_url, r.title, r.body, r.post_date_created) for r in fr.feed_items(read).collect())
    assert items == [(1, "rss", 0, "http://a/1", "A & B", "x <b>y</b>", "2015-11-26 12:48:30"), (1, "rss", 1, "http://a/2", "two", "", "2015-11-26 01:00:00"),
                     (2, "rdf", 0, "http://r/1", "R", "d", "2015-11-26 08:00:00"), (3, "atom", 0, "http://t/1", "T", "in bold", "2015-11-26 01:00:00"),
                     (4, "rss", 0, "http://a/1", "A & B", "x <b>y</b>", "2015-11-26 12:48:30")]
    errors = {r.id: (r.dialect, r.error) for r in fr.feed_errors(read).collect()}
    assert sorted(errors) == [4, 5, 6, 7, 8, 10]
    assert errors[4][0] == "rss" and errors[5] == (None, "not a feed") and errors[6] == errors[7] == (None, "empty payload")
    assert fr.read_feeds(spark.createDataFrame([], "id long, payload string")).collect() == []


def test_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ATOM)
    (tmp_path / "b.xml").write_bytes(RSS.encode("utf-16"))
    read = fr.read_feed_files(spark, str(tmp_path))
    assert fr.feed_items(read).count() == 3 and fr.feed_errors(read).count() == 0
    assert {r[0] for r in read.select(F.element_at(F.split("path", "/"), -1)).collect()} == {"a.xml", "b.xml"}
