"""Incremental daily totals (A3 / F2 run on a stream of uploaded files).

New Parquet files landing in a folder are read as a stream; a watermark
bounds the state kept for late rows; each micro-batch updates the per-day
sums.  The checkpoint folder lives under ``spark.checkpoint.dir`` so a
restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..session import shared_dir


def daily_totals_stream(spark: SparkSession, source_dir: str, schema: StructType, date_col: str,
                        value_col: str, series_col: str | None = None,
                        late: str = "2 days") -> DataFrame:
    """Streaming DataFrame: sid, day, value (sum), rows."""
    src = spark.readStream.schema(schema).parquet(source_dir)
    # watermarks need an instant: a wall-clock (NTZ) or date column is read
    # in the session time zone
    src = src.withColumn(date_col, F.col(date_col).cast("timestamp"))
    sid = F.col(series_col).cast("string") if series_col else F.lit("all")
    return (src.withWatermark(date_col, late)
               .groupBy(sid.alias("sid"), F.window(F.col(date_col), "1 day").alias("w"))
               .agg(F.sum(value_col).alias("value"), F.count(F.lit(1)).alias("rows"))
               .select("sid", F.to_date(F.col("w.start")).alias("day"), "value", "rows"))


def start(stream: DataFrame, name: str, sink: str = "memory", mode: str = "update",
          path: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Start the query with its checkpoint in the shared folder."""
    spark = stream.sparkSession
    w = (stream.writeStream.queryName(name).outputMode(mode).format(sink)
               .option("checkpointLocation", shared_dir(spark, f"streams/{name}")))
    if path:
        w = w.option("path", path)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
