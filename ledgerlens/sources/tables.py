"""Parquet scans of the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

TABLE_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str, wide: bool = False) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it.

    ``wide=True`` marks scans of CPU-heavy jobs such as parsing and profiling:
    they are dealt over the partitions the session asks for, if it does
    (``session.spread``).  Light aggregations keep the plain scan, where the
    partial aggregate shrinks the data before any shuffle.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if wide else df


class Tables:
    """Lazy accessor: ``Tables(spark, dir).lineitem`` is a parquet scan."""

    def __init__(self, spark: SparkSession, sf_dir: str, wide: bool = False):
        self.spark = spark
        self.sf_dir = sf_dir
        self.wide = wide

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return read_table(self.spark, self.sf_dir, name, self.wide)
        raise AttributeError(name)
