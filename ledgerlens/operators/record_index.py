"""Record index: deep pages (A10) and substring search (A8, A9) without a scan.

``build`` writes the records once more, range-partitioned and sorted by the
page order, one folder a range, each row with its position there; beside it a
rank directory (rows per range and their running total) and posting lists
(column, trigram) -> ranges.  A page then opens the one or two ranges that
hold its rows.  A search opens the ranges that hold every trigram of the term
in some column, and verifies each row there with the scan's own predicate;
terms without three literal characters in a row are scanned.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from ..functions import exprs, rules
from ..session import stage
from .dashboard import _search_predicate, shown

RANGE_ROWS = 100_000  # rows a range, about
GRAM = 3


class RecordIndex:
    """An index written by :func:`build`; ``schema`` is that of the records."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    @property
    def _stored(self) -> T.StructType:
        return T.StructType([T.StructField(f"_c{i}", f.dataType) for i, f in enumerate(self.schema.fields)]
                            + [T.StructField("_pos", T.LongType()), T.StructField("_range", T.LongType())])

    def rows(self) -> DataFrame:
        """All records with ``_range`` and ``_pos``."""
        return self.spark.read.schema(self._stored).parquet(f"{self.path}/rows").toDF(*self.schema.names, "_pos", "_range")

    def directory(self) -> DataFrame:
        """``_range, n, start``: rows of a range and rows of all before it."""
        return self.spark.read.schema("_range long, n long, start long").parquet(f"{self.path}/directory")

    def postings(self) -> DataFrame:
        return self.spark.read.schema("column int, gram string, _range long").parquet(f"{self.path}/postings")

    def page(self, limit: int = rules.PAGE_SIZE, offset: int = 0) -> DataFrame:
        """A10: the records at ``offset`` and after, in page order."""
        held = self.directory().where((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset)).collect()
        place = F.lit(False)
        for r in held:  # the ranges that hold the page
            place |= (F.col("_range") == r["_range"]) & F.col("_pos").between(max(0, offset - r["start"]), offset + limit - r["start"] - 1)
        return shown(self.rows().where(place).orderBy("_range", "_pos").select(*map(_q, self.schema.names)))

    def candidate_ranges(self, term: str) -> list[int] | None:
        """Ranges where some column holds every trigram of the term's literal
        parts; None if the term has none and all ranges must be read."""
        low = self.spark.sql("SELECT lower(:term) AS t", args={"term": term}).first()["t"]
        grams = sorted({p[i:i + GRAM] for p in re.split("[%_]", low) for i in range(len(p) - GRAM + 1)})
        if not grams:
            return None
        hit = self.postings().where(F.col("gram").isin(grams)).groupBy("column", "_range").agg(
            F.count_distinct("gram").alias("k")).where(F.col("k") == len(grams))
        return sorted(r["_range"] for r in hit.select("_range").distinct().collect())  # at most one row a range

    def search(self, term: str | None) -> DataFrame:
        """The records some column of which contains ``term``, as the scan finds them."""
        rows = self.rows()
        names = [_q(c) for c in self.schema.names]
        if not term:
            return rows.select(*names)
        ranges = self.candidate_ranges(term)
        if ranges is not None:
            rows = rows.where(F.col("_range").isin(ranges) if ranges else F.lit(False))
        return rows.select(*names).where(_search_predicate(self.schema, term))

    def match_count(self, term: str | None) -> DataFrame:
        """A9.  Output: total."""
        return self.search(term).agg(F.count(F.lit(1)).alias("total"))


def _q(name: str):
    return F.col(exprs.sql_ident(name))


def build(df: DataFrame, order_by: list[str], path: str, range_rows: int = RANGE_ROWS, search: bool = True) -> RecordIndex:
    """Write the index of ``df``; pages follow ``order_by`` (nulls first).

    Rows that are equal in ``order_by`` may stand in any order, fixed once
    written.  Rows equal in it that are more than a range stay in one range."""
    spark, schema = df.sparkSession, df.schema
    index = RecordIndex(spark, path, schema)
    plain = stage(df, "record-index").toDF(*[f"_c{i}" for i in range(len(schema))])
    ordinal = {c: i for i, c in enumerate(schema.names)}
    order = [F.col(f"_c{ordinal[c]}").asc_nulls_first() for c in order_by]
    n = plain.count()
    ranges = max(1, -(-n // range_rows))
    # the id of a sorted range partition's row: partition number, then row number
    placed = plain.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed.select(*plain.columns, F.expr("_id & 8589934591").alias("_pos"), F.expr("shiftright(_id, 33)").alias("_range")
                  ).write.partitionBy("_range").parquet(f"{index.path}/rows")
    rows = spark.read.schema(index._stored).parquet(f"{index.path}/rows")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    counts.select("_range", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).write.parquet(f"{index.path}/directory")
    if search:
        texts = F.array(*[F.struct(F.lit(i).alias("column"), F.lower(exprs.as_text(f"_c{i}", f.dataType)).alias("text"))
                          for i, f in enumerate(schema.fields)])
        values = rows.select("_range", F.explode(texts).alias("s")).select("_range", "s.column", "s.text").where(
            F.length("text") >= GRAM).distinct()
        grams = values.select("column", "_range", F.explode(F.expr(
            f"transform(sequence(1, length(text) - {GRAM - 1}), i -> substring(text, i, {GRAM}))")).alias("gram")).distinct()
        grams.select("column", "gram", "_range").repartitionByRange("gram").sortWithinPartitions("gram", "column").write.parquet(
            f"{index.path}/postings")
    return index
