"""Spark session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that matter for every job in this package: AQE re-plans joins
# and shuffle sizes with runtime statistics, coalesces small partitions
# and splits skewed ones; ANSI mode stays on (try_* functions used where
# bad input is expected).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

# Local mode runs everything in the driver JVM: give it the memory.
LOCAL_CONF = {"spark.driver.memory": "8g"}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "ledgerlens", extra: dict | None = None) -> SparkSession:
    """Session for tests and the local bench (on a cluster use spark-submit's)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        conf.update(LOCAL_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_BASE: str | None = None


def shared_dir(spark: SparkSession, sub: str = "") -> str:
    """Shared folder for lineage cuts and staged outputs.

    Read from ``spark.checkpoint.dir`` (the folder the cluster names);
    only when it is unset on a local master (tests) a scratch folder is
    created and registered; on a cluster an unset folder is an error.
    """
    global _LOCAL_BASE
    master = spark.conf.get("spark.master", "local")
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _LOCAL_BASE is None:
            _LOCAL_BASE = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
        base = _LOCAL_BASE
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    if sub:
        return base.rstrip("/") + "/" + sub.strip("/")
    return base


def env_sf_dir(default: str = "/root/testdata/sf0.01") -> str:
    return os.environ.get("BENCH_SF_DIR", default)


def spread(df):
    """Deal a scan over ``spark.ledgerlens.scanPartitions`` partitions, if the
    session sets it (a test file with one parquet row group is read by one
    task).  Unset, as on a cluster with many splits, a scan stays as it is.
    """
    n = df.sparkSession.conf.get("spark.ledgerlens.scanPartitions", None)
    return df.repartition(int(n)) if n else df


def stage(df, name: str = "stage"):
    """Write a derived DataFrame once to the shared folder and read it back.

    Used where several passes read the result of joins or heavy parsing:
    each pass then scans parquet (column pruning, vectorized reads) instead
    of re-running the lineage, and a lost executor re-reads files rather
    than replaying shuffles.  Columns are stored under positional names so
    any upload header (spaces, dots, brackets) is a valid parquet name.
    """
    spark = df.sparkSession
    path = shared_dir(spark, f"stage/{name}-{uuid.uuid4().hex}")
    names = df.columns
    df.toDF(*[f"_c{i}" for i in range(len(names))]).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).toDF(*names)


# Shuffle files of a query go when it ends, not when the driver happens to
# collect its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark):
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


def stage_parts(parts, name: str = "stage"):
    """``stage`` for large results: frames of the same columns are written one
    after another, so only one's shuffle files stand on the disks at a time, and
    more tightly.  Gives the frame that reads them and their folder."""
    path = None
    for part in parts:
        if path is None:
            spark, names = part.sparkSession, part.columns
            path = shared_dir(spark, f"stage/{name}-{uuid.uuid4().hex}")
        with shuffles_released(spark):
            part.toDF(*[f"_c{i}" for i in range(len(names))]).write.option("compression", "zstd").mode("append").parquet(path)
    return spark.read.parquet(path).toDF(*names), path


@contextmanager
def passing_stage(df, name: str = "stage"):
    """A staged frame and the bytes it takes, for the block only: the files go at its end."""
    spark = df.sparkSession
    staged, path = stage_parts([df], name)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        yield staged, fs.getContentSummary(at).getLength()
    finally:
        fs.delete(at, True)
