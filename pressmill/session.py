"""Session helpers.

Cluster jobs get their session from the launcher; ``build_session`` is for
tests, the bench and local runs. Settings that matter for results (UTC
session zone, ANSI mode) are pinned here and re-asserted by
``ensure_conf`` on any session handed to us.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

PERF_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # pages carry whole HTML documents: keep Arrow batches small in the
    # Python extraction stages so one batch never holds a large share of a task
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "pressmill") -> SparkSession:
    builder = (SparkSession.builder
               .master(master or os.environ.get("PRESSMILL_MASTER", "local[*]"))
               .appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", os.environ.get("PRESSMILL_DRIVER_MEMORY", "16g"))
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for k, v in {**RESULT_CONF, **PERF_CONF}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_conf(spark)
    return spark


def ensure_conf(spark: SparkSession) -> None:
    """Pin the settings results depend on (zone, ANSI) and make the package
    importable by the Python workers."""
    for k, v in RESULT_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ship_package(spark)


#: Rows per Arrow batch handed to a Python worker at most, where rows carry whole texts or pages.
TEXT_BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, whatever the session came with."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_BATCH_ROWS:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Distribute this package to the executors' Python workers (once per
    SparkContext): functions run by mapInPandas / applyInPandasWithState are
    unpickled there and import ``pressmill``."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a Connect session ships code with addArtifacts instead
        return
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="pressmill-pkg-"), "pressmill.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    On a cluster the launcher names it in ``spark.checkpoint.dir``; we read
    it from the session. Only when it is unset (tests, local runs) do we
    pick a scratch folder of our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="pressmill-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


# tables whose rows carry whole texts: the per-row work (regex, segmentation,
# n-grams) is CPU-heavy, so these must be spread over all task slots
TEXT_TABLES = {"documents", "pages", "conversations", "benchmark"}


def spread(df):
    """Repartition when the scan yields fewer partitions than task slots.

    Large inputs arrive as many files/row groups and pass through untouched;
    a small input stored as one row group would otherwise run all its
    CPU-heavy text work in a single task."""
    try:
        slots = df.sparkSession.sparkContext.defaultParallelism
        parts = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD API (e.g. a Connect session): leave the layout alone
        return df
    return df.repartition(slots) if parts < slots else df


def read_table(spark: SparkSession, sf_dir: str, name: str):
    df = spark.read.parquet(table_path(sf_dir, name))
    return spread(df) if name in TEXT_TABLES else df


def materialize(df):
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder
    (used for small derived tables that are counted, then broadcast)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
