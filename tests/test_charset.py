import pytest
from pyspark.sql import functions as F

from pressmill.functions import charset as ch
from pressmill.operators import extract

TEXT = "<html><head>{}<title>Größe – né</title></head><body><article><p>Übergrößen é</p></article></body></html>"
PLAIN = TEXT.replace(" – né", " né")


@pytest.mark.parametrize("payload,content_type,charset,name", [
    (TEXT.encode("utf-8-sig"), "text/html; charset=windows-1252", None, "UTF-8"),
    (TEXT.encode("utf-16"), "text/html", None, "UTF-16LE"), ("﻿".encode("utf-16-be") + TEXT.encode("utf-16-be"), None, None, "UTF-16BE"),
    (TEXT.encode("utf-16-le"), "text/html; charset=utf-16le", None, "UTF-16LE"), (TEXT.encode("utf-16-be"), "text/html", None, "UTF-16BE"),
    (TEXT.encode("cp1252"), 'text/html; charset="Windows-1252"', None, "WINDOWS-1252"), (TEXT.encode("utf-8"), "text/html; charset=utf8", None, "UTF-8"),
    (PLAIN.encode("latin-1"), "text/html; charset=iso-8859-1", None, "WINDOWS-1252"), (TEXT.encode("utf-8"), "text/html", "ISO-8859-1", "UTF-8"),
    (TEXT.format("<meta charset=iso-8859-1>").replace("–", "-").encode("latin-1"), "text/html", None, "WINDOWS-1252"),
    (TEXT.format('<META http-equiv="Content-Type" content="text/html; charset=windows-1251">').encode("utf-8"), "text/html", None, "WINDOWS-1251"),
    (TEXT.format('<meta charset="utf-16">').encode("utf-8"), "text/html", None, "UTF-8"), (TEXT.encode("utf-8"), None, None, "UTF-8"),
    (TEXT.encode("cp1252"), None, "", "WINDOWS-1252"), (b"", "text/html", None, "UTF-8"), (b"\xff\xfe", None, None, "UTF-16LE")])
def test_mark_header_meta_pattern(spark, payload, content_type, charset, name):
    df = spark.createDataFrame([(bytearray(payload), content_type, charset)], "payload binary, content_type string, charset string")
    got = df.select(ch.sniff(F.col("payload"), F.col("content_type"), F.col("charset")).alias("cs"), "payload")
    row = got.select("cs", ch.page_text(F.col("payload"), F.col("cs")).alias("t")).first()
    assert row.cs == name
    if name != "WINDOWS-1251" and len(payload) > 2:
        assert "Größe" in row.t and "Übergrößen é" in row.t and not row.t.startswith("﻿")


def test_pages_in_many_charsets_give_the_same_article(spark):
    forms = [(PLAIN.format('<meta charset="utf-8">').encode("utf-8"), "text/html"), (PLAIN.encode("utf-16"), "text/html"),
             (PLAIN.encode("cp1252"), "text/html; charset=windows-1252"), (PLAIN.format("<meta charset=latin1>").encode("latin-1"), "text/html"),
             (PLAIN.encode("latin-1"), "text/html"), (PLAIN.encode("utf-8"), "text/html; charset=ISO-8859-1")]
    rows = [(str(i), None, 200, c, None, bytearray(p)) for i, (p, c) in enumerate(forms)] + [("x", None, 200, "text/html", None, None)]
    df = spark.createDataFrame(rows, "url string, final_url string, status int, content_type string, charset string, payload binary")
    got = {r.url: (r.title, r.body) for r in extract.page_articles(df).collect()}
    assert got == {str(i): ("Größe né", "<p>Übergrößen é</p>") for i in range(len(forms))}
