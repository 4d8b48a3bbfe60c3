import numpy as np
from pyspark.sql import types as T

from pressmill.llm import quality as ql

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("grade", T.StringType()), T.StructField("keep", T.StringType())])


def test_gradient_steps_reach_the_likelihood_of_a_known_model():
    rng = np.random.default_rng(5)
    truth, cuts = np.array([2.0, -1.5, 0.5]), np.array([-1.0, 1.0])
    rows, grades = [], []
    for _ in range(4_000):
        x = rng.normal(size=3)
        p = 1 / (1 + np.exp(-(cuts - truth @ x)))
        g = int(np.searchsorted(p, rng.random()))
        rows.append((np.array([1, 2, 3], np.int32), x.astype(np.float32), g))
        grades.append(g)
    m = ql.fit(rows, grades=3, epochs=25, decay=0.0)
    assert np.allclose(m.weights[1:4], truth, atol=0.25) and np.allclose(m.thresholds, cuts, atol=0.25)
    tails = m.tails(np.array([0.0, 3.0]))
    assert (tails[:, 0] >= tails[:, 1]).all() and (tails[1] > tails[0]).all()


def test_features_of_whole_texts():
    at, x = ql.features("Alpha beta ALPHA!! 12\nAlpha beta ALPHA!! 12")
    assert len(at) == len(set(at.tolist()))
    words = [b for b in at.tolist() if b < ql._BLOCKS]
    assert len(words) == 2  # alpha, beta
    shares = x[at >= ql._BLOCKS]
    assert np.isclose(shares.sum(), ql.SHARE_SCALE * (1 + 0.5 + 0.5))
    long = "word " * 100_000 + "lastword"
    assert ql._word("lastword")[0] in ql.features(long)[0]
    assert len(ql.features(None)[0]) == len(ql.features(" \n ")[0]) == 0


def test_held_out_ratings(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rated = ql.graded(spark.read.parquet(f"{sf}/labels.parquet"))
    model = ql.train(docs, rated.where("doc_id % 5 != 0"))
    held = rated.where("doc_id % 5 = 0")
    rows = ql.assess(docs.join(held, "doc_id", "left_semi"), model).join(held, "doc_id").collect()
    keep = {g: np.mean([r["keep"] for r in rows if r.grade == g]) for g in range(3)}
    assert keep[2] > 0.98 and keep[0] < 0.1 and keep[1] < 0.8
    mean = [np.mean([r.expected_grade for r in rows if r.grade == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]


def test_nulls_ties_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "good text here", "x", "y"), (1, "good text here", "x", "y"), (2, None, None, None),
                                (None, "", "x", "y"), (3, "bad### text###", "x", "y")], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, None), (2, None, 1), (None, 1, 1), (9, 1, None)],
                                   "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.grade) for r in ql.graded(labels).collect()} == {(1, 2), (3, 0), (9, 2)}
    model = ql.train(df, ql.graded(labels))
    assert ql.assess(df, model).count() == 5
    assert ql.keep_good(df, model).columns == df.columns
    blank = ql.train(df, ql.graded(labels.limit(0)))
    rows = ql.assess(df, blank).collect()
    assert all(r["keep"] and r.p_top == r.p_usable == 0.5 for r in rows)
    assert ql.assess(df.limit(0), model).collect() == []


def test_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, f"text {i}", "x", "y") for i in range(50)], SCHEMA)
    rated = spark.createDataFrame([(i, i % 3) for i in range(50)], "doc_id long, grade int")
    seen = []
    real = ql.fit
    ql.fit = lambda rows, grades: seen.append(len(rows)) or real(rows, grades)
    try:
        ql.train(df.unionByName(df), rated, max_rated=10)
    finally:
        ql.fit = real
    assert seen == [10]


def test_shape_reads_the_whole_word():
    word = "a" * 64
    assert ql._word.__wrapped__(word + "9" * 64)[1] != ql._word.__wrapped__(word + "a" * 64)[1]
