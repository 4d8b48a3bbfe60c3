from pyspark.sql import functions as F

from pressmill.operators import frontier

NOW = "2024-01-31 00:00:00"


def _searches(spark):
    return spark.createDataFrame([
        (1, "search_engine", "q1", "google, bing", 2, True, "hourly", "2024-01-30 22:59:59", None, None, None, None),
        (2, "search_engine", "q2", "google_cse", 15, True, "daily", "2024-01-30 00:00:00", None, None,
         '{"exactTerms": "x", "excludeTerms": ""}', None),
        (3, "rss", None, "google", 0, True, "weekly", None, "http://f/rss", None, None, None),
        (4, "article", None, "google", 0, False, "daily", None, None, "http://a/1", None, None),
        (5, "search_engine", "q5", "google", 0, True, "yearly", "2024-01-02 00:00:00", None, None, None, None),
        (6, "email", None, "google", 0, True, "daily", None, None, None, None, None),
    ], "id long, search_type string, query string, source string, search_depth int, active boolean, "
       "period string, last_processed string, rss_link string, article_url string, options string, "
       "email_links string").withColumn("last_processed", F.col("last_processed").cast("timestamp"))


def test_due_rules(spark):
    due = sorted(r["id"] for r in frontier.due_searches(_searches(spark), NOW).collect())
    # 1: hourly, 1h01s ago; 2: daily, exactly 1 day ago is not due (strict >); 3: never run;
    # 4: inactive; 5: unknown period = 30 days, 29 days ago; 6: never run
    assert due == [1, 3, 6]


def test_work_and_request_plan(spark):
    s = _searches(spark).withColumn("active", F.lit(True)).withColumn("last_processed", F.lit(None).cast("timestamp"))
    mail = spark.createDataFrame([(10, 6, '{"a": {"links": ["http://m/1", "http://m/2"]}, "b": {}}'),
                                  (11, 6, None)], "message_id long, search_pk long, email_links string")
    w = frontier.search_work(s, NOW, mail)
    kinds = sorted((r["search_pk"], r["kind"], r["target"], r["engine"]) for r in w.collect())
    assert (6, "url", "http://m/1", None) in kinds and (6, "url", "http://m/2", None) in kinds
    assert (1, "engine", "q1", "bing") in kinds and (3, "rss", "http://f/rss", None) in kinds
    assert (4, "url", "http://a/1", None) in kinds
    plan = frontier.request_plan(w, frontier.engine_spec(spark))
    rows = sorted((r["search_pk"], r["engine"], r["page"], r["start"], r["size"]) for r in plan.collect())
    assert (1, "bing", 1, 11, None) in rows and (1, "google", 1, 10, None) in rows
    cse = [r for r in rows if r[1] == "google_cse"]
    assert len(cse) == 10 and cse[-1][3] == 91          # depth 15 clamped to 10
    assert not [r for r in rows if r[0] == 5]            # depth 0: no page
    params = plan.filter("engine = 'google_cse'").select("params").first()[0]
    assert params["exactTerms"] == "x" and params["q"] == "q2"


def test_options_override_only_where_the_engine_takes_them(spark):
    w = spark.createDataFrame([(1, "engine", "own", "google_cse", 1, '{"q": "other", "siteSearch": "a"}'),
                               (2, "engine", "own", "bing", 1, '{"q": "other"}'), (3, "engine", "own", "google_cse", 1, None)],
                              "search_pk long, kind string, target string, engine string, depth int, options string")
    got = {r["search_pk"]: r["params"] for r in frontier.request_plan(w, frontier.engine_spec(spark)).collect()}
    assert got == {1: {"q": "other", "siteSearch": "a"}, 2: {"q": "own"}, 3: {"q": "own"}}


def test_each_engine_gets_its_own_parameters(spark):
    engines = ["google", "google_scholar", "google_news", "google_cse", "google_blogs", "bing", "social", "yandex"]
    w = spark.createDataFrame([(1, "engine", "a b", e, 2, '{"safe": "off"}' if e == "google_cse" else None) for e in engines],
                              "search_pk long, kind string, target string, engine string, depth int, options string")
    got = {(r["engine"], r["page"]): (r["address"], r["request"])
           for r in frontier.request_plan(w, frontier.engine_spec(spark)).collect()}
    assert got["google", 1] == ("https://google.com/search", {"q": "a b", "start": "10", "sa": "N"})
    assert got["google_blogs", 0][1] == {"q": "a b", "start": "0", "tbm": "nws", "tbs": "nrt:b"}
    assert got["google_cse", 1][1] == {"q": "a b", "start": "11", "safe": "off"}  # an option overrides
    assert got["google_news", 0][1] == {"q": "a b", "num": "20", "output": "rss"}
    assert got["bing", 1][1] == {"q": "a b", "first": "11"}
    assert got["social", 0][1] == {"q": "a b", "limit": "20"}
    assert got["yandex", 0] == (None, {"q": "a b"})


def test_candidates_and_new_urls(spark):
    c = frontier.normalise_candidates(spark.createDataFrame([("http://a/",), ("http://a/",), ("http://b/",)],
                                                            "candidate string"))
    assert c.first()["candidate"]["article_url"] == "http://a/"
    cand = c.select(F.col("candidate.article_url").alias("article_url"))
    store = spark.createDataFrame([("http://b/",)], "article_url string")
    assert [r[0] for r in frontier.new_urls(cand, store).collect()] == ["http://a/"]
    bad = spark.createDataFrame([("google, altavista",)], "source string")
    assert bad.select(frontier.invalid_sources(F.col("source"))).first()[0] == ["altavista"]
