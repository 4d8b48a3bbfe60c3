import fnmatch
import random
import re

from pyspark.sql import types as T

from pressmill.llm import url_filter as uf


def glob_regex(p):
    return re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p), re.S)


def test_automaton_against_regular_expressions():
    rng = random.Random(9)
    for _ in range(60):
        patterns = ["".join(rng.choice("ab.#*?é") for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 12))]
        texts = ["".join(rng.choice("ab.#é\n中") for _ in range(rng.randint(0, 12))) for _ in range(40)]
        got = uf.Automaton(patterns).matches(texts)
        for k, p in enumerate(patterns):
            want = glob_regex(p)
            for i, t in enumerate(texts):
                assert got[i, k] == bool(want.fullmatch(t)), (p, t)
    assert fnmatch.fnmatchcase("abc", "a*c")  # same wildcards as the shell's, without classes


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in uf.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    if best:
        return host, path, best[1], best[0]
    for verdict, g in uf.GLOBS:
        if glob_regex(g).fullmatch(f".{host}#{path}" if host or path else ""):
            return host, path, None, verdict
    return host, path, None, uf.DEFAULT


URLS = [None, "", "no scheme", "http://", "://", "http://net", "http://net/", "HTTP://A.NET/x", "http://example.net/en/",
        "http://example.net/en", "http://a.b.example.net/en/q?x#y", "http://notexample.net/en/a", "http://example.com/de/x",
        "http://x.example.com/de/", "http://example.com/DE/x", "http://org/fr/", "http://a.org/fr/b", "http://a.org/x/fr/",
        "http://e.com/a.net/", "http://e.com#.net/", "http://e.com?.net/", "http://u@a.net:80/", "ftp://x://a.net/en/",
        "http://spam-farm.example.com/x", "http://www.cheap-pills.org", "http://q.com/a/wp-login.php?r=1", "http://É.NET/ü",
        "http://a.net\n/x", "http://" + "a." * 20_000 + "net/" + "y" * 30_000]


def test_rules_nulls_long_and_clashing_columns(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                           T.StructField("rule", T.StringType()), T.StructField("_url", T.StringType())])
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, "http://a.net/", "x", "y")] * 2, schema)
    rows = uf.judge(df).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        url = URLS[r.page_id] if r.page_id is not None else "http://a.net/"
        assert (r.host, r.path, r.rule, r.verdict) == brute(url), url
    assert uf.judge(df.limit(0)).collect() == []
    plain = uf.judge(df, rules=(), globs=(), default="block").collect()
    assert {(r.rule, r.verdict) for r in plain} == {(None, "block")}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in uf.op6_url_filter(spark, sf).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id])
