from pyspark.sql import functions as F

from pressmill.operators import dedup, lang, translate


def test_scatter_gather_keeps_order_and_blanks_unknown_parts(spark):
    body = " ".join(["word"] * 300) + ". " + " ".join(["next"] * 300) + "."
    arts = spark.createDataFrame([(1, "fr", "Titre court.", body, False)],
                                 "id long, source_language string, title string, body string, translated boolean")
    parts = translate.scatter(arts)
    assert parts.filter("field = 'body'").count() == 2
    memory = (parts.filter("part_no = 1 OR field = 'title'")
              .select("source", "text", F.concat(F.lit("EN:"), F.col("part_no").cast("string")).alias("translated")))
    g = translate.translate_articles(arts, memory).collect()[0]
    # body part 0 is not in the memory -> '' ; part 1 -> 'EN:1'; order kept
    assert g["translated_body"] == "EN:1"
    assert g["translated_title"] == "EN:0" and g["translated"] is True


def test_keep_first_last_with_a_hot_url(spark):
    df = spark.range(5000).select(F.col("id"),
                                  F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
                                  .alias("article_url"))
    first = {r["article_url"]: r["id"] for r in dedup.keep_first(df).collect()}
    last = {r["article_url"]: r["id"] for r in dedup.keep_last(df).collect()}
    assert first["hot"] == 0 and last["hot"] == 4998
    assert len(first) == 1 + 5000 - 1667
    rep = {r["article_url"]: r["n"] for r in dedup.duplicate_report(df).collect()}
    assert rep == {"hot": 1667}
    assert dedup.removed_duplicates(df).count() == 1666


def test_language_fill_and_agreement(spark):
    train = spark.createDataFrame(
        [(1, "the quick brown fox jumps over the lazy dog and the cat", "en"),
         (2, "le renard brun saute par dessus le chien paresseux et le chat", "fr")],
        "doc_id long, text string, lang string")
    prof, prior = lang.train_profiles(train)
    arts = spark.createDataFrame([(10, "", "the dog and the cat jump"), (11, "fr", "the dog"),
                                  (12, None, "le chien et le chat")],
                                 "id long, source_language string, body string")
    got = {r["id"]: r["source_language"] for r in lang.fill_language(arts, prof, prior).collect()}
    assert got == {10: "en", 11: "fr", 12: "fr"}
    assert spark.range(1).select(lang.agree(F.lit("en"), F.lit("fr")), lang.agree(F.lit("fr"), F.lit("fr"))) \
        .first()[:] == ("", "fr")
