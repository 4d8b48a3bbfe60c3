"""Skew-safe ordering: exact positions and per-key predecessors, hot key included."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmill.operators.ordering import global_index, keyed_lag


def _skewed(spark):
    # key 0 holds a third of the rows
    return spark.range(3000).select(
        F.col("id").alias("eid"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97).alias("k"),
        ((F.col("id") * 7919) % 5003).alias("t"),
        (F.col("id") % 11).alias("v"))


def test_global_index_matches_row_number(spark):
    df = _skewed(spark)
    got = {r["eid"]: r["position"] for r in global_index(df, [F.col("t").desc(), F.col("eid")], n_parts=7).collect()}
    w = Window.orderBy(F.col("t").desc(), F.col("eid"))
    want = {r["eid"]: r["p"] for r in df.select("eid", (F.row_number().over(w) - 1).alias("p")).collect()}
    assert got == want


def test_keyed_lag_matches_window_lag(spark):
    df = _skewed(spark)
    got = {r["eid"]: (r["prev_t"], r["prev_v"]) for r in
           keyed_lag(df, "k", [F.col("k"), F.col("t"), F.col("eid")], ["t", "v"], n_parts=9).collect()}
    w = Window.partitionBy("k").orderBy("t", "eid")
    want = {r["eid"]: (r["pt"], r["pv"]) for r in
            df.select("eid", F.lag("t").over(w).alias("pt"), F.lag("v").over(w).alias("pv")).collect()}
    assert got == want
