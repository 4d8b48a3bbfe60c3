import corpus_pipeline as cp
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill.llm import language_id, quality
from tests.llm.test_near_dedup import brute
from tests.llm.test_packing import check_layout

SF = "/root/testdata/sf0.01"


def blankless(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in docs.collect()}

    good = cp.good_quality(spark, docs, SF)
    assert good.columns == docs.columns
    model = quality.train(docs, quality.graded(spark.read.parquet(f"{SF}/labels.parquet")))
    ids = sorted(rows)
    tails = model.judge([rows[d].text for d in ids])[1][:, quality.LEAST_GRADE - 1]
    want = {d for d, p in zip(ids, tails) if p >= quality.LEAST_TAIL}
    assert {r.doc_id for r in good.select("doc_id").collect()} == want
    clean = {d for d, q in labels.items() if q == (1, 0)}
    assert len(clean & want) / len(clean) > 0.98

    known = cp.known_language(spark, good, SF)
    kept = {r.doc_id for r in known.select("doc_id").collect()}
    assert known.columns == docs.columns and len(want - kept) <= 0.01 * len(want)

    left = cp.without_copies(spark, known, SF)
    best = {}
    for d in sorted(kept):
        key = blankless(rows[d].text)
        if key not in best or len(rows[d].text) > len(rows[best[key]].text):
            best[key] = d
    assert sorted(r.doc_id for r in left.select("doc_id").collect()) == sorted(best.values())

    rest = cp.without_near_copies(spark, left, SF)
    groups = brute([(d, rows[d].text) for d in best.values()], 5)
    assert sorted(r.doc_id for r in rest.select("doc_id").collect()) == sorted({c for _, c in groups.values()})

    pieces = cp.packed(spark, rest, SF).collect()
    check_layout(pieces, 2048)
    assert {r.doc_id for r in pieces} == {c for _, c in groups.values()}


def test_run_applies_all_stages(spark):
    sf = "/root/testdata/sf0.001"
    got = cp.run(spark, sf)
    check_layout(got.collect(), 2048)
    assert got.select("doc_id").distinct().count() < spark.read.parquet(f"{sf}/documents.parquet").count()


def test_stages_on_odd_rows(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType()), T.StructField("kept", T.StringType()),
                           T.StructField("group_size", T.ArrayType(T.IntegerType()))])
    text = "the one and only text of a few words more"
    rows = [(1, text, "en", "s", 1, "x", [1]), (1, text, "en", "s", 1, "x", [1]), (2, text.replace(" ", "\n"), "en", "s", 1, None, None),
            (3, None, None, None, None, None, None), (4, "", "en", "s", 0, "x", []), (None, text + " yet", "en", "s", 1, "x", [2]),
            (5, "12 !?", "en", "s", 5, "x", [3])]
    docs = spark.createDataFrame(rows, schema)
    assert cp.without_copies(spark, docs, SF).columns == docs.columns
    left = cp.without_copies(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == sorted(
        [(1, text), (0, text + " yet"), (3, ""), (5, "12 !?")])
    model = language_id.train(docs)
    assert {r.doc_id for r in language_id.keep_known(docs, model).collect()} == {1, 2, None}
    near = cp.without_near_copies(spark, docs, SF)
    assert near.columns == docs.columns and near.where(F.col("doc_id") == 2).count() == 0
    assert cp.packed(spark, docs, SF).count() == len(rows)
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).count() == 0
