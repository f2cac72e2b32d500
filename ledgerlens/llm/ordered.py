"""Exact positions in the rows of a key, without a key's rows in one task.

Rows are range-partitioned by key and order, so a hot key spreads over many
ranges.  Each range numbers its own runs while it streams; one summary row a
range carries the count of a key that goes on from the ranges before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import staged, task_id


def numbered(df: DataFrame, key: str, order: list, name: str) -> DataFrame:
    """``df`` (written once) and ``_range, _run, _at``: the range of a row, the
    number of its key's run there, and its position from 0 in its key by
    ``order``.  Ranges ascend by ``key`` (a long, not null), then ``order``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import IntegerType, LongType, StructType

    schema = StructType(df.schema.fields + []).add("_range", IntegerType()).add("_run", LongType()).add("_at", LongType())
    arrow = to_arrow_schema(schema)

    def run(batches):
        last, runs, at, mine = None, -1, -1, task_id()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.names.index(key)).to_numpy(zero_copy_only=False)
            new = np.r_[last is None or keys[0] != last, keys[1:] != keys[:-1]]
            rows = np.arange(len(keys))
            since = np.maximum.accumulate(np.where(new, rows, -1))
            pos = np.where(since < 0, at + 1 + rows, rows - since)
            number = runs + np.cumsum(new)
            last, runs, at = keys[-1], int(number[-1]), int(pos[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(keys), mine), pa.int32()), pa.array(number, pa.int64()),
                 pa.array(pos, pa.int64())], schema=arrow)

    ranges = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    rows = staged(ranges.mapInArrow(run, schema), name)
    most = F.struct(key, "_at")
    ends = sorted(rows.groupBy("_range").agg(F.min(key).alias("first"), F.max(most).alias("last")).collect(),
                  key=lambda r: r["_range"])  # one row a range
    carry, held, count = [], None, 0
    for r in ends:
        own = r["last"]["_at"] + 1
        if r["first"] == held:
            carry.append((r["_range"], held, count))
        count = own + (count if r["last"][key] == held else 0)
        held = r["last"][key]
    if not carry:
        return rows
    before = rows.sparkSession.createDataFrame(carry, "_range int, _key long, _before long")
    moved = rows.join(F.broadcast(before), "_range", "left")  # at most one row a range
    return moved.withColumn("_at", F.when(F.col("_key") == F.col(key), F.col("_at") + F.col("_before")).otherwise(F.col("_at"))
                            ).select(*schema.names)
