"""Helpers shared by the llm operators: scans, staged tables, batch loops."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir

# Rows leave a Python task in batches of about this many payload bytes.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 8192
IN_ROWS = 1024  # whole texts that are Python objects at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder (zstd parquet) and read it back.

    Cuts the lineage with files every executor can read: a lost executor
    re-reads them.  Values made per task (partition numbers, positions) are
    fixed by the one committed attempt of each task.
    """
    spark = df.sparkSession
    path = shared_dir(spark, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clustered(df: DataFrame, name: str, *cols: str) -> DataFrame:
    """As :func:`staged`, in a file for each hash of ``cols``: joins on all of
    them read its rows in place, so only the other side is shuffled."""
    spark = df.sparkSession
    path = shared_dir(spark, f"llm/{name}-{uuid.uuid4().hex}")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = f"ledgerlens_{uuid.uuid4().hex}"
    df.repartition(n, *cols).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, *cols).saveAsTable(held)
    out = spark.table(held)
    spark.sql(f"DROP TABLE {held}")  # the name alone: the files stay, and the frame knows them
    return out


def task_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def map_rows(df: DataFrame, rows: Callable[[Iterator[dict[str, list]]], Iterable[tuple]],
             schema: str, in_rows: int | None = None) -> DataFrame:
    """``mapInArrow`` over column lists: ``rows`` gets each batch (of
    ``in_rows`` rows at most, if given) as ``{column: list}`` and yields
    output tuples in the order of ``schema``.
    Output batches close after ``BATCH_ROWS`` rows or ``BATCH_BYTES`` of
    text and binary values, so a task's memory does not follow its input.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    struct = _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)
    max_rows, max_bytes = BATCH_ROWS, BATCH_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(out):
            cols = list(zip(*out)) if out else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

        def lists():
            for batch in batches:  # Arrow's batches may be large: a part at a time becomes Python objects
                for at in range(0, batch.num_rows, in_rows or max(1, batch.num_rows)):
                    b = batch.slice(at, in_rows)
                    yield {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}

        out, size = [], 0
        for row in rows(lists()):
            out.append(row)
            size += sum(len(v) for v in row if isinstance(v, (bytes, str, list)))
            if len(out) >= max_rows or size >= max_bytes:
                yield flush(out)
                out, size = [], 0
        if out:
            yield flush(out)

    return df.mapInArrow(run, struct)


def renamed(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under the operator's own names: further
    columns of the input, whatever they are called, cannot clash."""
    return df.select(*[df[c].alias(n) for n, c in cols.items()])
