"""Function-only items: lookups (K8), address/asset/charset helpers (P8, P10, P14, P15), F14, A7."""

from pyspark.sql import functions as F

from pressmill.functions import urls as ux
from pressmill.operators import export, frontier


def test_lookups(spark):
    sources, types = export.lookups(spark)
    assert sources.count() == 8 and types.count() == 5
    assert sources.filter("value = 'google_cse'").first()["label"] == "Google CSE"


def test_small_helpers(spark):
    df = spark.createDataFrame([("10.0.0.1", "http://x/a.png", bytearray("né".encode("utf-8")), "ISO-8859-1")],
                               "addr string, u string, b binary, cs string")
    r = df.select(ux.remote_addr("addr").alias("a"), ux.asset_name("u", "png").alias("f"),
                  ux.decode_payload(F.col("b"), F.col("cs")).alias("t"),
                  ux.sanitize_utf8(F.lit("ok")).alias("s")).first()
    assert r["a"] == "http://10.0.0.1/"
    assert r["f"].endswith(".png") and r["f"] == df.select(ux.asset_name("u", "png")).first()[0]
    assert r["t"] == "né" and r["s"] == "ok"


def test_required_lists_and_backlog(spark):
    df = spark.createDataFrame([(1, ["http://a"]), (2, []), (3, None)], "id int, url_list array<string>")
    assert [r["id"] for r in frontier.non_empty_lists(df).collect()] == [1]
    assert export.backlog_exists(df) is True
    assert export.backlog_exists(df.filter("id > 5")) is False
