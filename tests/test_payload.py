import json

from pressmill.operators import export

FIELDS = ["article_url", "source_language", "title", "translated_title", "body", "translated_body", "authors",
          "post_date_created", "post_date_crawled", "translated", "top_image_url", "top_image", "processed", "search_id",
          "channel", "status", "locations", "tags"]


def test_whole_transfer_document_with_and_without_enrichment(spark):
    plain = spark.sql("""SELECT 1L id, 0L batch_id, 'u' article_url, 'en' source_language, 't' title, 't' translated_title, 'b' body,
        'b' translated_body, timestamp'2020-01-02 03:04:05' post_date_crawled, true translated, true processed, 's' search_id,
        'general' channel, 'keep' status""")
    doc = json.loads(export.payload(plain).first()["payload"])
    assert list(doc) == FIELDS
    assert doc["tags"] == [] and doc["locations"] is None and doc["authors"] is None
    rich = plain.selectExpr("*", "'A, B' authors", "timestamp'2020-01-01 00:00:00' post_date_created", "'i' top_image_url",
                            "'f' top_image", """'{"coordinates":[{"name":"Kyiv","type":"city"}]}' locations""")
    tags = spark.createDataFrame([(1, ["x", "y"])], "id long, tags array<string>")
    doc = json.loads(export.payload(rich, tags).first()["payload"])
    assert list(doc) == FIELDS
    assert doc["tags"] == [{"name": "x"}, {"name": "y"}]
    assert doc["locations"] == {"coordinates": [{"name": "Kyiv", "type": "city"}]}
    assert (doc["authors"], doc["post_date_created"], doc["top_image"]) == ("A, B", "2020-01-01 00:00:00", "f")
