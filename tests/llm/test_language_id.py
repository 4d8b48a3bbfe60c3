import math
import zlib
from collections import Counter

from pyspark.sql import types as T

from pressmill.llm import language_id as li

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("score", T.StringType()),
                       T.StructField("lang_pred", T.StringType())])


def brute_grams(text, orders=li.ORDERS):
    clean, last = [], False
    for c in text.lower():
        if c.isalpha():
            clean.append(c)
        elif last or not clean:
            clean.append(" ")
        last = c.isalpha()
    clean = "".join(clean)
    return Counter(clean[i:i + n] for n in orders for i in range(len(clean) - n + 1) if clean[i:i + n] != " ")


def test_grams_count_as_plain_slicing_does():
    texts = ["Hello, wörld!  42", "", "a", "!!", "İstanbul x", "the the\nthe"]
    bucket, owner, has = li.grams(texts, buckets=1 << 20)
    assert has.tolist() == [True, False, True, False, True, True]
    for k, t in enumerate(texts):
        # a text's trailing blank comes from the joining mark
        want = brute_grams(t if k == len(texts) - 1 else t + "\n")
        got = Counter(bucket[owner == k].tolist())
        assert sum(got.values()) == sum(want.values())
        assert sorted(got.values()) == sorted(want.values())


def test_model_equals_naive_bayes_by_hand(spark):
    rows = [(1, "aba ab", "x"), (2, "bab", "x"), (3, "ccc cd", "y"), (4, None, "y"), (5, "zz", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = li.train(df)
    assert m.languages == ["x", "y"]
    counts = {"x": Counter(), "y": Counter()}
    for t, lang in (("aba ab", "x"), ("bab", "x"), ("ccc cd", "y")):
        counts[lang].update(li.grams([t])[0].tolist())
    for k, lang in enumerate(m.languages):
        total = sum(counts[lang].values())
        for b, n in counts[lang].items():
            assert math.isclose(m.logs[b, k], math.log((n + li.SMOOTHING) / (total + li.SMOOTHING * li.BUCKETS)), rel_tol=1e-5)
    assert math.isclose(math.exp(m.prior[0]), 2 / 3)
    labels, scores = m.predict(["abab", "cdc", None, "12 !", ""])
    assert labels == ["x", "y", "und", "und", "und"] and scores[2:].tolist() == [0, 0, 0]


def test_held_out_accuracy_and_fold(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in li.op8_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        assert got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2)
    held = [d for d in docs if got[d.doc_id].held_out]
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nulls_long_repeated_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "ab " * 600_000, "x", "s", "p"), (None, None, "x", None, None), (2, "", None, "s", "p"),
                                (1, "cd", "y", "s", "p"), (1, "cd", "y", "s", "p")], SCHEMA)
    m = li.train(df)
    rows = li.identify(df, m).collect()
    assert sorted(r.lang_pred for r in rows) == ["und", "und", "x", "y", "y"]
    kept = li.keep_known(df, m)
    assert kept.columns == df.columns and kept.count() == 3
    none = li.train(df.limit(0))
    assert {r.lang_pred for r in li.identify(df, none).collect()} == {"und"}
    assert li.identify(df.limit(0), m).collect() == []


FOREIGN = {
    "polish": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem "
              "i sumieniem i powinni postępować wobec innych w duchu braterstwa. ",
    "russian": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью. ",
    "chinese": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
    "noise": "xkq zvbw jjfh qpwt vzxk bqnm wrtg hjkl zxcv qwrt pfgh vbnm kjhg xzcq wqpz ",
}


def test_pipeline_drops_unlearned_languages_scripts_and_noise(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = li.train(li.learning_rows(docs))
    alien = spark.createDataFrame([(-k, t * n, None) for k, (t, n) in enumerate(
        [(t, n) for t in FOREIGN.values() for n in (2, 20)], 1)], docs.schema)
    assert [r.doc_id for r in li.keep_known(alien, model).collect()] == []
    assert li.keep_known(docs, model).count() >= 0.99 * docs.count()
