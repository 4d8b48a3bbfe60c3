"""Trash rules (J3) and status (G1-G4): the rule truth table as rows."""

from pyspark.sql import functions as F

from pressmill.operators import triage

# (rule url, rule text, rule length, article url, body, expected is_trash)
CASES = [
    ("example.com", ".", 0, "http://www.example.com/sample.html", None, True),
    ("example2.com", ".", 0, "http://www.example.com/sample.html", None, False),
    (".", "JavaScipt", 100, "http://example.com/", "JavaScipt" + "a" * 100, False),
    (".", "JavaScipt", 100, "http://example.com/", "JavaScipt blocked", True),
    (".", "JavaScipt", 0, "http://example.com/", "JavaScipt" + "a" * 100, True),
    ("example.com", "JavaScipt", 0, "http://example.com/", "JavaScipt blocked", True),
    ("example.com", "JavaScipt", 0, "http://example2.com/", "JavaScipt blocked", False),
    ("example.com", ".", 0, "http://www.example.com/sample.html", "", True),
]


def test_trash_truth_table(spark):
    for i, (ru, rt, rl, url, body, want) in enumerate(CASES):
        rules = spark.createDataFrame([(1, ru, rt, rl)], "id long, url string, text string, length int")
        arts = spark.createDataFrame([(i, url, body)], "id long, article_url string, body string")
        got = triage.mark_trash(arts, rules).collect()[0]["is_trash"]
        assert got == want, (i, ru, rt, rl, url, body)


def test_default_rule_does_not_match_newline_body(spark):
    rules = spark.createDataFrame([(1, ".", ".", 0)], "id long, url string, text string, length int")
    arts = spark.createDataFrame([(1, "http://a/", "\n")], "id long, article_url string, body string")
    assert triage.mark_trash(arts, rules).collect()[0]["is_trash"] is False


def test_rules_are_literal_conditions_without_a_join(spark):
    rules = spark.createDataFrame([(i, f"a{i}", ".", i) for i in range(300)], "id long, url string, text string, length int")
    arts = spark.range(100).select(F.col("id"), F.concat(F.lit("http://a"), F.col("id")).alias("article_url"),
                                   F.lit("body").alias("body"))
    marked = triage.mark_trash(arts, rules)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    # rule 0 has no length limit, rules 1 to 3 are too short for the body
    assert {r["id"] for r in marked.filter(~F.col("is_trash")).collect()} == {1, 2, 3}
    hits = triage.trash_hits(arts, rules).filter("id = 45").collect()
    assert {r["rule_id"] for r in hits} == {4, 45}
    none = triage.mark_trash(arts, rules.limit(0)).filter("is_trash").count()
    assert none == 0 and triage.trash_hits(arts, rules.limit(0)).count() == 0


def test_status_channels_and_reset(spark):
    rules = spark.createDataFrame([(1, "trash\\.example", ".", 0)], "id long, url string, text string, length int")
    searches = spark.createDataFrame([(1, "research"), (2, "search_engines")], "id long, channel string")
    arts = spark.createDataFrame(
        [(1, "http://ok.example/a", "x", 1, None, None), (2, "http://ok.example/b", "x", 2, None, None),
         (3, "http://trash.example/c", "x", 1, None, None), (4, "http://ok.example/d", "x", None, None, "other"),
         (5, "http://ok.example/e", "x", 2, "keep", None)],
        "id long, article_url string, body string, search_pk long, status string, channel string")
    out = {r["id"]: (r["channel"], r["status"]) for r in triage.assign_status(arts, rules, searches).collect()}
    assert out[1] == ("research", "keep")          # research channel -> keep
    assert out[2] == ("search_engines", "raw")     # search engines -> raw
    assert out[3] == ("research", "trash")         # a matching rule wins
    assert out[4] == ("other", "keep")             # no search: own channel
    assert out[5] == ("search_engines", "keep")    # an existing status is kept
    changed = {r["id"]: r["new_status"] for r in triage.status_changes(
        spark.createDataFrame([(6, "http://ok.example/f", "x", "raw", "research")],
                              "id long, article_url string, body string, status string, channel string"),
        rules).collect()}
    assert changed == {6: "keep"}                  # raw + research resets to keep
    binary = spark.createDataFrame([("keep", False), ("keep", True), (None, False)], "status string, html boolean")
    got = [r[0] for r in binary.select(triage.binary_to_trash(F.col("status"), F.col("html"))).collect()]
    assert got == ["trash", "keep", "trash"]
