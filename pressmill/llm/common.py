"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.session import ensure_conf, materialize, table_path

#: Rows per Arrow batch handed to a Python worker: rows carry whole texts, so a
#: batch must stay small when some of them are very long.
TEXT_BATCH_ROWS = 256


def prepare(spark: SparkSession) -> SparkSession:
    """Pin result settings, keep Arrow batches of whole texts small, and let each query's shuffle
    files go when it ends: what an operator needs later it has checkpointed."""
    ensure_conf(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) != TEXT_BATCH_ROWS:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named table, reduced to ``cols`` (all if none is named)."""
    prepare(spark)
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*cols) if cols else df


def bucket_of(parts: int, *cols):
    """A bucket in [0, parts) from the columns' hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(parts)).cast("int")


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def compact(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """A checkpoint of ``df`` in as few partitions as its rows need: what is derived
    from a small table then runs in few tasks and leaves few shuffle files."""
    kept = materialize(df)
    return kept.coalesce(max(1, -(-kept.count() // rows)))


__all__ = ["TEXT_BATCH_ROWS", "bucket_of", "compact", "materialize", "prepare", "read", "shuffle_parts"]
