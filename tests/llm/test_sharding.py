import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill.llm import sharding as sh

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("shard", T.StringType()), T.StructField("slot", T.StringType())])


def check(rows, shards):
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) <= set(range(shards))
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sh.op7_shards(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    check(rows, 40)
    for r in rows:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id]) + 16, zlib.crc32(docs[r.doc_id]), "rows", None)


def test_matrix_has_exact_margins_and_the_right_law():
    rng = np.random.default_rng(0)
    for _ in range(30):
        blocks = rng.integers(0, 50, rng.integers(1, 9)).tolist()
        m = sh.communication_matrix(blocks, 7, int(rng.integers(1 << 30)))
        assert m.sum(axis=1).tolist() == blocks and m.min() >= 0
        assert m.sum(axis=0).max() - m.sum(axis=0).min() <= 1
    draws = np.array([sh.communication_matrix([6, 14], 2, s)[0, 0] for s in range(4_000)])
    # of 20 rows, 6 in the block, 10 in the shard: mean 3, variance 6 * .5 * .5 * 14 / 19
    assert abs(draws.mean() - 3) < 0.08 and abs(draws.var() - 6 * 0.25 * 14 / 19) < 0.1
    big = [sh._hypergeometric(np.random.default_rng(s), 6 * 10**9, 4 * 10**9, 1_000_000) for s in range(300)]
    assert abs(np.mean(big) - 600_000) < 150 and 400 < np.std(big) < 580


def test_shuffle_is_deterministic_and_mixes(spark):
    df = spark.range(5_000).select(F.col("id").alias("doc_id"))
    one = {r.doc_id: (r.shard, r.slot) for r in sh.shuffle_to_shards(df, shards=8).collect()}
    two = {r.doc_id: (r.shard, r.slot) for r in sh.shuffle_to_shards(df.repartition(7), shards=8).collect()}
    assert one == two
    order = np.array([one[i][0] * 10_000 + one[i][1] for i in range(5_000)])
    assert abs(np.corrcoef(np.arange(5_000), order)[0, 1]) < 0.06
    neighbours = np.mean([one[i][0] == one[i + 1][0] for i in range(4_999)])
    assert abs(neighbours - 1 / 8) < 0.02


def test_nulls_repeated_rows_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(None, None, "x", "y")] * 30 + [(1, "a", "x", "y")] * 30 + [(2, "", None, None)] * 7, SCHEMA)
    rows = sh.shuffle_to_shards(df, shards=5, block_rows=10, least_blocks=2).collect()
    assert len(rows) == 67
    check(rows, 5)
    assert sh.shuffle_to_shards(df.limit(0)).collect() == []
    few = sh.shuffle_to_shards(df.limit(3), shards=40).collect()
    assert len({r.shard for r in few}) == 3


def test_main_path_is_native(spark):
    plan = sh.op7_shards(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
