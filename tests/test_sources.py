"""Sources on the reference's golden payloads (read-only sample files) and on inline pages."""

import pytest
from pyspark.sql import functions as F

from pressmill.sources import feeds
from pressmill.sources import html_results as hr
from tests.conftest import golden


def needs(kind):
    return pytest.mark.skipif(golden(kind) is None, reason=f"no golden {kind} payload found")


def _payload(spark, kind):
    return spark.read.text(golden(kind), wholetext=True).select(
        F.lit(kind).alias("request"), F.col("value").alias("payload"))


@needs("rss")
def test_rss_golden(spark):
    rows = feeds.parse_rss(_payload(spark, "rss")).orderBy("item_no").collect()
    assert len(rows) == 9
    first = rows[0]
    assert first["article_url"] == "http://www.oie.int/wahis_2/public/wahid.php/Reviewreport/Review?reportid=23744"
    assert first["title"] == "Niger : Anthrax"
    assert first["body"] == "Report date : 2017-05-17 16:34:10<br />Country : Niger<br />Disease: : Anthrax"
    assert first["post_date_created"] == "2017-05-17 16:36:27"     # 17:36:27 +0100 in UTC


@needs("rss")
def test_rss_file_source(spark):
    rows = feeds.read_rss_files(spark, golden("rss")).collect()
    assert len(rows) == 9 and rows[0]["title"] == "Niger : Anthrax"


@needs("json_results")
def test_cse_golden(spark):
    rows = feeds.parse_cse(_payload(spark, "json_results"), request="request").collect()
    assert len(rows) == 10
    assert all(r["article_url"] for r in rows)


@needs("json_posts")
def test_social_golden(spark):
    posts, errors = feeds.parse_social(_payload(spark, "json_posts"))
    rows = posts.orderBy("item_no").collect()
    assert len(rows) == 10 and errors.count() == 0
    assert rows[0]["article_url"] == "http://twitter.com/Infern_arny/statuses/854307064516161536"
    assert rows[0]["title"] == "twitter - @A  r  n  y"
    assert len(rows[0]["body"]) > 0


@needs("xml_search")
def test_xml_golden(spark):
    items, totals, errors = feeds.parse_xml_search(_payload(spark, "xml_search"))
    rows = items.orderBy("item_no").collect()
    assert len(rows) == 10 and errors.count() == 0
    assert rows[0]["article_url"] == "https://yandex.ru/"
    assert rows[0]["title"] == "Яндекс\n              \n              — поисковая система и интернет-портал"
    assert len(rows[6]["body"]) > 0
    t = totals.collect()[0]
    assert t["found"] == 127585012 and t["pages"] == 100.0


def test_xml_error_envelope(spark):
    df = spark.createDataFrame([("r", '<yandexsearch><response><error code="15">No results</error></response></yandexsearch>'),
                                ("s", '<yandexsearch><response><error>Bad</error></response></yandexsearch>')],
                               "request string, payload string")
    items, totals, errors = feeds.parse_xml_search(df)
    assert items.count() == 0 and totals.count() == 0
    assert sorted((r["code"], r["description"]) for r in errors.collect()) == [(0, "Bad"), (15, "No results")]


def test_xml_groups_of_several_docs(spark):
    doc = "<doc><url>http://{0}/</url><title>T<hlword>x</hlword>{0}</title></doc>"
    group = "<group>" + doc.format(1) + doc.format(2) + "</group><group></group><group>" + doc.format(3) + "</group>"
    df = spark.createDataFrame([(1, "<yandexsearch><response><results><grouping>" + group + "</grouping></results></response></yandexsearch>")],
                               "id int, payload string")
    items = sorted((r.item_no, r.article_url, r.title) for r in feeds.parse_xml_search(df)[0].collect())
    assert items == [(0, "http://1/", "Tx1"), (1, "http://2/", "Tx2"), (2, "http://3/", "Tx3")]


def test_cse_request_without_items_gives_nothing(spark):
    df = spark.createDataFrame([("q1", '{"items": [{"link": "http://a", "title": "A", "snippet": "s"}]}'),
                                ("q1", '{"kind": "x"}'),
                                ("q2", '{"items": [{"link": " http://b ", "title": "B", "snippet": "t"}]}')],
                               "request string, payload string")
    rows = feeds.parse_cse(df, "request").collect()
    assert [(r["request"], r["article_url"]) for r in rows] == [("q2", "http://b")]


def test_html_result_pages(spark):
    google = ('<html><head><title>Google</title></head><body>'
              '<div class="g"><h3><a href="/url?q=http://x.org/a%3Fb%3D1&amp;sa=U">Title A</a></h3>'
              '<span class="st">Snippet &amp; more</span></div>'
              '<div class="g"><a href="http://plain.org/">B</a></div></body></html>')
    scholar = ('<div class="gs_ri"><a href="http://s.org/1">S1</a><div class="gs_rs">abstract</div></div>'
               '<div class="gs_ri"><a href="http://s.org/2">S2</a></div>')
    bing = '<ol><li class="b_algo x"><h2><a href="http://b.org/">Bing A</a></h2><p>snip</p></li></ol>'
    df = spark.createDataFrame([(1, "google", google), (2, "google_scholar", scholar), (3, "bing", bing),
                                (4, "nosuch", google)], "id int, engine string, payload string")
    rows = sorted((r["id"], r["item_no"], r["article_url"], r["title"], r["body"])
                  for r in hr.parse_html_results(df).collect())
    assert rows == [(1, 0, "http://x.org/a?b=1", "Title A", "Snippet & more"),
                    (1, 1, "http://plain.org/", "B", ""),
                    (2, 0, "http://s.org/1", "S1", "abstract"),
                    (3, 0, "http://b.org/", "Bing A", "snip")]


def test_url_files(spark, tmp_path):
    (tmp_path / "links.txt").write_text("http://a.org/1\n\n  http://b.org/2 \n")
    (tmp_path / "links.json").write_text('[{"link": "http://c.org/"}, {"link": "http://d.org/"}]')
    assert [r[0] for r in feeds.read_url_lines(spark, str(tmp_path / "links.txt")).collect()] == \
        ["http://a.org/1", "http://b.org/2"]
    assert [r[0] for r in feeds.read_link_objects(spark, str(tmp_path / "links.json")).collect()] == \
        ["http://c.org/", "http://d.org/"]
