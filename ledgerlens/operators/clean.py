"""Upload cleaning.

``clean(df)`` turns an upload (text or typed columns) into a typed, gap-free
dataset plus a cleaning report.  The plan, per pass:

1. de-duplicate: one ``groupBy`` over every column, keeping the earliest
   row position (map-side partial aggregation collapses a hot duplicate);
   each text value is parsed once (number, date) next to its text and the
   result is written to the shared folder, so the passes below scan parsed
   columns and an executor loss does not replay the shuffle.  A large upload
   is written first and de-duplicated in rounds by a hash of the row: the
   shuffle files of one round are all that stands on the disks.
2. inference: one aggregate of per-column conditional counts (one row).
3. fill values: medians in one aggregate; modes from each column's
   ``groupBy(value).count()`` reduced with ``min_by`` -- bounded
   memory whatever the number of distinct texts.
4. typed projection; dates forward/backward filled in row order by a
   two-level scan (per range partition, then carries across partitions) to
   which rows without a gap lend their dates only.
5. quartiles of the imputed numeric columns, then one outlier count pass.
The driver only sees the one-row aggregates (a few values per column).
"""

from __future__ import annotations

from functools import cached_property, reduce

import numpy as np

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import exprs, rules
from ..session import passing_stage, shuffles_released, stage_parts
from .profile import one_row
from .quantiles import exact_quantiles

# Date text shapes and the format tried for each.  A format is only tried
# when the text has its shape: a failed parse is an exception inside the
# JVM, far more costly than the regex test.
ISO_DATE_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
DATE_FORMATS = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"),
    # day first, reached only where the month-first reading failed
    (r"^(1[3-9]|2\d|3[01])/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^(1[3-9]|2\d|3[01])/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "d/M/yyyy H:mm"),
    (r"^(1[3-9]|2\d|3[01])/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "d/M/yyyy H:mm:ss"),
]


# Separator each shape needs (no shape has fewer than 8 characters).
# Testing these on the UTF-8 bytes is far cheaper than a regex, which
# decodes the value first, so each shape's regex only runs on candidates.
ISO_NEEDS = "-"
FORMAT_NEEDS = ["/", "/", "/", "-", ",", " ", "/", ",", " ", "/", "/", "/"]
DATE_MIN_CHARS = 8


def parse_date(c) -> Column:
    """Mixed-format text -> timestamp; unparseable -> null."""
    s = F.trim(exprs.col(c).cast("string"))
    tries = [F.when(s.contains(ISO_NEEDS) & s.rlike(ISO_DATE_SHAPE), s.try_cast("timestamp"))]
    tries += [F.when(s.contains(need) & s.rlike(shape), F.try_to_timestamp(s, F.lit(fmt)))
              for (shape, fmt), need in zip(DATE_FORMATS, FORMAT_NEEDS)]
    return F.when(F.length(s) >= DATE_MIN_CHARS, F.coalesce(*tries))


def parse_date_sql(c: str) -> str:
    """SQL text of ``parse_date`` applied to the SQL expression ``c``."""
    return read_date_sql(date_text_sql(f"CAST({c} AS STRING)"))


def date_text_sql(v: str) -> str:
    """SQL text of a trimmed text that may be a date, else null.  Most values
    fail on the untrimmed bytes: too short, or no separator (', ' holds a blank)."""
    needs = " OR ".join(f"contains({v}, {exprs.sql_str(n)})" for n in ("-", "/", " "))
    return f"(CASE WHEN length({v}) >= {DATE_MIN_CHARS} AND ({needs}) THEN trim({v}) END)"


def read_date_sql(t: str) -> str:
    """SQL text of the timestamp that a trimmed text reads as."""
    S = exprs.sql_str
    tries = [f"CASE WHEN contains({t}, {S(ISO_NEEDS)}) AND {t} RLIKE {S(ISO_DATE_SHAPE)} "
             f"THEN try_cast({t} AS TIMESTAMP) END"]
    tries += [f"CASE WHEN contains({t}, {S(need)}) AND {t} RLIKE {S(shape)} "
              f"THEN try_to_timestamp({t}, {S(fmt)}) END"
              for (shape, fmt), need in zip(DATE_FORMATS, FORMAT_NEEDS)]
    return f"CASE WHEN length({t}) >= {DATE_MIN_CHARS} THEN coalesce({', '.join(tries)}) END"


def to_bool(c) -> Column:
    """Boolean tokens -> true/false, anything else -> null."""
    t = exprs.norm_token(c)
    return (F.when(t.isin(*rules.BOOL_TRUE_TOKENS), F.lit(True))
             .when(t.isin(*rules.BOOL_FALSE_TOKENS), F.lit(False)))


def clean_text(c) -> Column:
    """Trimmed text, null tokens -> null."""
    t = F.trim(exprs.col(c).cast("string"))
    return F.when(~t.isin(*rules.TEXT_NULL_TOKENS), t)


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def dedupe(df: DataFrame, order_by=None) -> DataFrame:
    """Drop exact duplicate rows, keep the first.

    Adds ``_ord`` (row position: the ``order_by`` key -- expressions over
    the row's own columns -- else the scan position) and ``_copies`` (rows
    folded into this one).
    """
    return _fold_copies(df if order_by else _positioned(df), df.columns, order_by)


def _positioned(df: DataFrame) -> DataFrame:
    return df.withColumn("_ord", F.monotonically_increasing_id())


def _order_key(order_by) -> Column:
    return F.struct(*[exprs.col(c) for c in order_by])


def _fold_copies(df: DataFrame, cols: list[str], order_by=None) -> DataFrame:
    per_row = df.groupBy(*[_q(c) for c in cols])
    copies = F.count(F.lit(1)).alias("_copies")
    if order_by:
        # the key is a function of the row's columns, so every copy has the
        # same key: compute it after the grouping (fixed-width hash buffers)
        return per_row.agg(copies).withColumn("_ord", _order_key(order_by))
    return per_row.agg(F.min("_ord").alias("_ord"), copies)


# De-duplication shuffles whole rows, far more bytes than they take written: so
# many bytes of the written upload are shuffled at a time, in so many rounds at most.
ROUND_BYTES = 16 << 20
ROUNDS = 8


def distinct_candidates(df: DataFrame, order_by=None) -> DataFrame:
    """``parse_candidates`` of the de-duplicated rows, staged.

    The rows are written once as they come, which ends the lineage (and shuffles)
    that made them.  All copies of a row have one hash and so meet in one round."""
    cols = df.columns
    with passing_stage(df if order_by else _positioned(df), "clean-upload") as (raw, size):
        rounds = max(1, min(ROUNDS, -(-size // ROUND_BYTES)))
        own = F.pmod(F.xxhash64(*[_q(c) for c in cols]), F.lit(rounds))
        folded = [_fold_copies(raw.where(own == r) if rounds > 1 else raw, cols, order_by) for r in range(rounds)]
        if order_by:  # read from the row's columns again, cheaper than written
            folded = [f.drop("_ord") for f in folded]
        rows, _ = stage_parts([parse_candidates(f, cols) for f in folded], "clean-candidates")
    return rows.withColumn("_ord", _order_key(order_by)) if order_by else rows


def parse_candidates(dd: DataFrame, cols: list[str]) -> DataFrame:
    """Every reading a text column may need, parsed once per value.

    Adds ``_p{i}`` (number) and ``_d{i}`` (timestamp) next to each text
    column; native columns stay as they are.  The caller stages this once,
    so inference, medians, the typed projection and the outlier pass all
    read parsed columns instead of running the regexes again.

    The rules are stated once and applied to the array of a row's texts: stated
    once a column they are more code than the JVM compiles.
    """
    schema = {f.name: f.dataType for f in dd.schema.fields}
    texts = [i for i, c in enumerate(cols) if exprs.logical_type(schema[c]) is None]
    if not texts:
        return dd
    row = f"array({', '.join(f'CAST({exprs.sql_ident(cols[i])} AS STRING)' for i in texts)})"
    numbers = f"transform(transform({row}, v -> {exprs.strip_currency_sql('v')}), s -> {exprs.read_number_sql('s')})"
    dates = f"transform(transform({row}, v -> {date_text_sql('v')}), t -> {read_date_sql('t')})"
    read = dd.selectExpr("*", f"{numbers} AS _numbers", f"{dates} AS _dates")
    return read.selectExpr(*[exprs.sql_ident(c) for c in dd.columns], *[e for k, i in enumerate(texts) for e in (
        f"_numbers[{k}] AS _p{i}", f"_dates[{k}] AS _d{i}")])


def infer_types(cand: DataFrame, cols: list[str]) -> dict:
    """Logical type of every column from counts of its parsed readings
    (one small aggregate a column, in one job)."""
    schema = {f.name: f.dataType for f in cand.schema.fields}
    branches = []
    for i, c in enumerate(cols):
        p, d = (f"_p{i}", f"_d{i}") if exprs.logical_type(schema[c]) is None else ("CAST(NULL AS DOUBLE)", "NULL")
        branches.append(cand.selectExpr("count(1) AS n", f"count({exprs.sql_ident(c)}) AS nn", f"count({p}) AS p",
                                        f"count_if({p} % 1 != 0) AS fr", f"count({d}) AS dt").selectExpr(f"{i} AS i", "*"))
    found = reduce(DataFrame.unionAll, branches).collect()  # one row per column
    row = {f"{k}{r['i']}": r[k] for r in found for k in ("nn", "p", "fr", "dt")}
    # words for true and false are looked for where neither numbers nor dates prevail
    tokens = ", ".join(exprs.sql_str(t) for t in rules.BOOL_INFER_TOKENS)
    words = [i for i, c in enumerate(cols) if exprs.logical_type(schema[c]) is None and row[f"nn{i}"]
             and max(row[f"p{i}"], row[f"dt{i}"]) <= row[f"nn{i}"] * rules.PARSE_SHARE]
    other = cand.selectExpr(*[f"count_if(NOT (lower(trim(CAST({exprs.sql_ident(cols[i])} AS STRING))) IN ({tokens}))) AS nb{i}"
                              for i in words]).first() if words else {}
    kinds = {}
    for i, c in enumerate(cols):
        nn = row[f"nn{i}"]
        native = exprs.logical_type(schema[c])
        if nn == 0:
            kinds[c] = "Text"
        elif native is not None:
            kinds[c] = native
        elif row[f"p{i}"] > nn * rules.PARSE_SHARE:
            kinds[c] = "Integer" if row[f"fr{i}"] == 0 else "Float"
        elif row[f"dt{i}"] > nn * rules.PARSE_SHARE:
            kinds[c] = "DateTime"
        elif other[f"nb{i}"] == 0:
            kinds[c] = "Boolean"
        else:
            kinds[c] = "Text"
    n = found[0]["n"]
    # columns with values to fill in: numbers
    gaps = {c for i, c in enumerate(cols) if kinds[c] in ("Integer", "Float")
            and (row[f"nn{i}"] if exprs.logical_type(schema[c]) is not None else row[f"p{i}"]) < n}
    # and dates
    gaps |= {c for i, c in enumerate(cols) if kinds[c] == "DateTime"
             and (row[f"nn{i}"] if exprs.logical_type(schema[c]) is not None else row[f"dt{i}"]) < n}
    return {"kinds": kinds, "n": n, "gaps": gaps}


def null_shares(dd: DataFrame, cols: list[str]) -> dict[str, float]:
    """Percentage of nulls of every column, from one aggregate."""
    row = dd.selectExpr("count(1) AS _n", *[f"count_if({exprs.sql_ident(c)} IS NULL) AS z{i}" for i, c in enumerate(cols)]).first()
    n = row["_n"]
    # numpy rounding of (nulls / rows) * 100, as the reference computes it
    return {c: (float(np.rint(row[f"z{i}"] / n * 100.0 * 100.0) / 100.0) if n else 0.0) for i, c in enumerate(cols)}


def _numeric_value(cols: list[str], c: str, dtype: T.DataType) -> Column:
    """Numeric reading of a column of the candidate table."""
    if exprs.logical_type(dtype) in ("Integer", "Float"):
        return _q(c).cast("double")
    return F.col(f"_p{cols.index(c)}")


def modes(df: DataFrame, columns: dict[str, Column]) -> dict:
    """Most frequent non-null value of each expression; ties -> smallest.

    Counts each expression's values by themselves (partial aggregation per
    partition; a branch reads only its own column) and keeps the best value per
    column with ``min_by`` over (-count, value) -- no group is ever collected.
    """
    if not columns:
        return {}
    names = list(columns)
    counts = reduce(DataFrame.unionAll, [
        df.select(e.cast("string").alias("v")).where(F.col("v").isNotNull()).groupBy("v")
          .agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(i).alias("k"), "v", "cnt") for i, e in enumerate(columns.values())])
    with shuffles_released(df.sparkSession):  # of many different texts they are large
        best = counts.groupBy("k").agg(
            F.min_by("v", F.struct((-F.col("cnt")).alias("c"), F.col("v").alias("v"))).alias("mode"))
        return {names[r["k"]]: r["mode"] for r in best.collect()}  # one row per column


def fill_dates(df: DataFrame, cols: list[str], order_col: str = "_ord",
               fallback: Column | None = None) -> DataFrame:
    """Forward fill, then back fill, then ``fallback`` -- in row order.

    Two-level scan instead of one global window: rows are range
    partitioned on the order key; within each range the last non-null value
    is carried along; one row per range (bounded by the partition count, so
    it is broadcast) supplies the value from earlier ranges.  Only rows
    before the very first value are filled from behind, all with that value.

    Rows without a gap stay where they are: they send their position and
    dates along, nothing else.
    """
    if not cols:
        return df
    fallback = F.current_timestamp() if fallback is None else fallback
    rest = [c for c in df.columns if c not in cols]
    gap = reduce(Column.__or__, [_q(c).isNull() for c in cols])
    dates = [f"_d{j}" for j in range(len(cols))]
    # a struct's fields one by one: same order, but sorted by their bytes
    key = df.schema[order_col].dataType
    key = [_q(order_col).getField(f) for f in key.names] if isinstance(key, T.StructType) else [_q(order_col)]
    by = [f"_o{i}" for i in range(len(key))]
    sent = df.select(*[k.alias(o) for k, o in zip(key, by)], *[_q(c).alias(d) for c, d in zip(cols, dates)],
                     F.when(gap, F.struct(*[_q(c).alias(f"_r{i}") for i, c in enumerate(rest)])).alias("_row"))
    ordered = sent.repartitionByRange(*by).sortWithinPartitions(*by).drop(*by)
    kinds = {f.name: f.dataType for f in ordered.schema.fields}
    schema = T.StructType([T.StructField("_rng", T.IntegerType()), *[T.StructField(d, kinds[d]) for d in dates],
                           *[T.StructField(f"_b{d}", kinds[d]) for d in dates], T.StructField("_row", kinds["_row"])])
    # written once: the rows to fill and, without a ``_row``, the ends of each range
    ranged, _ = stage_parts([ordered.mapInArrow(_carry_forward(len(cols)), schema)], "date-gaps")
    before = Window.orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_rng").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one row per range partition: a size bound that does not grow with rows
    carries = ranged.where("_row IS NULL").select(
        "_rng", *[F.last(d, ignorenulls=True).over(before).alias(f"_c{d}") for d in dates],
        *[F.first(f"_b{d}", ignorenulls=True).over(whole).alias(f"_f{d}") for d in dates])
    held = ranged.where("_row IS NOT NULL").drop(*[f"_b{d}" for d in dates]).join(F.broadcast(carries), "_rng", "left")
    value = {c: F.coalesce(d, f"_c{d}", f"_f{d}", fallback) for c, d in zip(cols, dates)}
    value |= {c: F.col(f"_row._r{i}") for i, c in enumerate(rest)}
    return df.where(~gap).unionByName(held.select(*[value[c].alias(c) for c in df.columns]))


def _carry_forward(n: int):
    """For ``mapInArrow`` over a range's rows in order, ``n`` dates and ``_row``:
    the rows that have one, with the last date up to each, and at the end one
    row without: the range's last and first dates."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        last, first, types, names = [None] * n, [None] * n, None, None
        for batch in batches:
            types = [pa.int32(), *2 * batch.schema.types[:n], batch.schema.types[n]]
            names = ["_rng", *batch.schema.names[:n], *[f"_b{d}" for d in batch.schema.names[:n]], "_row"]
            size, filled = batch.num_rows, []
            for j in range(n if size else 0):
                own = batch.column(j)
                if first[j] is None and own.null_count < size:
                    first[j] = own.drop_null()[0]
                own = pc.fill_null_forward(own)
                filled.append(own if last[j] is None else pc.fill_null(own, last[j]))
                if filled[j][size - 1].is_valid:
                    last[j] = filled[j][size - 1]
            row = batch.column(n)
            if row.null_count < size:
                columns = [pa.repeat(pa.scalar(at, types[0]), size), *filled, *[pa.nulls(size, t) for t in types[1:n + 1]], row]
                yield pa.RecordBatch.from_arrays(columns, names).filter(row.is_valid())
        if names:
            ends = [pa.scalar(at, types[0]), *last, *first, None]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, t) if v is None else pa.repeat(v, 1) for v, t in zip(ends, types)], names)

    return run


class Cleaned:
    """C1-C15 of an upload; every part is computed when it is asked for.

    ``data``: cleaned dataset (+ net_amount when derived); ``report``: C15,
    one row; ``null_report``: C2; ``types``: C3; ``outliers``: C7.  All parts
    but the null report read the same written rows; it needs no parsed reading
    and counts the de-duplicated rows themselves, unless they are written.
    """

    def __init__(self, df: DataFrame, order_by=None, approx: bool = False, checkpoint: bool = True,
                 now: Column | None = None):
        df = exprs.nan_to_null(df)
        self.cols = df.columns
        self.schema = {f.name: f.dataType for f in df.schema.fields}
        self.approx, self.now, self.spark = approx, now, df.sparkSession
        self.checkpoint = checkpoint
        self.upload, self.order_by = df, order_by
        self.distinct = dedupe(df, order_by)

    @cached_property
    def rows(self) -> DataFrame:
        """De-duplicated rows with every parsed reading, written once to the
        shared folder: the lineage cut that the passes below all scan."""
        return distinct_candidates(self.upload, self.order_by) if self.checkpoint else parse_candidates(self.distinct, self.cols)

    @cached_property
    def info(self) -> dict:
        return infer_types(self.rows, self.cols)

    def _of_kind(self, *kinds: str) -> list[str]:
        return [c for c in self.cols if self.info["kinds"][c] in kinds]

    @property
    def numeric(self) -> list[str]:
        return self._of_kind("Integer", "Float")

    def _quantiles(self, df: DataFrame, values: dict, at: list[float]) -> dict:
        if not values:
            return {}
        if not self.approx:
            return exact_quantiles(df, values, at)
        row = df.agg(*[F.percentile_approx(v, at, 10000).alias(f"q{i}") for i, v in enumerate(values.values())]).first()
        return {c: [None if x is None else float(x) for x in row[f"q{i}"] or [None] * len(at)] for i, c in enumerate(values)}

    @cached_property
    def medians(self) -> dict:
        """Medians of the parsed numeric columns with gaps to fill (exact, bounded memory)."""
        wanted = [c for c in self.numeric if c in self.info["gaps"]]
        values = {c: _numeric_value(self.cols, c, self.schema[c]) for c in wanted}
        return {c: q[0] for c, q in self._quantiles(self.rows, values, [0.5]).items()}

    @cached_property
    def modes(self) -> dict:
        """Modes of the boolean and text columns."""
        return modes(self.rows, {**{c: to_bool(_q(c)) for c in self._of_kind("Boolean")},
                                 **{c: clean_text(_q(c)) for c in self._of_kind("Text")}})

    def _number(self, c: str) -> Column:
        """C4-C6 of one numeric column."""
        v, fill = _numeric_value(self.cols, c, self.schema[c]), self.medians.get(c)
        if c in self.info["gaps"]:
            v = F.coalesce(v, F.lit(0.0 if fill is None else float(fill)))
        v = v.cast("double")
        return exprs.np_round(v, 4) if self.info["kinds"][c] == "Float" else v  # C6: numpy's half-even, 4 places

    def _typed(self, c: str) -> Column:
        kind = self.info["kinds"][c]
        if kind in ("Integer", "Float"):
            return self._number(c)
        if kind == "Boolean":
            m = self.modes.get(c)
            return F.coalesce(to_bool(_q(c)), F.lit(True if m is None else (m == "true")))
        if kind == "DateTime":
            native = exprs.logical_type(self.schema[c]) == "DateTime"
            return _q(c).cast("timestamp") if native else F.col(f"_d{self.cols.index(c)}")
        m = self.modes.get(c)
        return F.coalesce(clean_text(_q(c)), F.lit(rules.TEXT_FILL if m is None else m))

    @cached_property
    def data(self) -> DataFrame:
        typed = self.rows.select(*[self._typed(c).alias(c) for c in self.cols], "_ord")
        typed = fill_dates(typed, [c for c in self._of_kind("DateTime") if c in self.info["gaps"]], "_ord", self.now)
        # C14: derived net amount
        if "net_amount" not in self.cols and "quantity" in self.cols and "unit_price" in self.cols:
            typed = typed.withColumn("net_amount", F.col("quantity") * F.col("unit_price"))
        return typed.drop("_ord")

    @cached_property
    def outliers(self) -> DataFrame:
        """column_name, q1, q3, outliers (IQR fences on the imputed columns,
        then one counting pass; dates play no part)."""
        if not self.numeric:
            return self.spark.createDataFrame([], "column_name string, q1 double, q3 double, outliers long")
        filled = self.rows.select(*[self._number(c).alias(c) for c in self.numeric])
        fences = self._quantiles(filled, {c: _q(c) for c in self.numeric}, [0.25, 0.75])
        cnt = []
        for c in self.numeric:
            q1, q3 = fences[c]
            iqr = q3 - q1
            lo, hi = q1 - rules.IQR_FACTOR * iqr, q3 + rules.IQR_FACTOR * iqr
            cnt.append(F.struct(F.lit(c).alias("column_name"), F.lit(q1).alias("q1"), F.lit(q3).alias("q3"),
                                F.count_if((_q(c) < lo) | (_q(c) > hi)).alias("outliers")))
        return filled.agg(F.array(*cnt).alias("o")).select(F.inline("o"))

    @cached_property
    def report(self) -> DataFrame:
        """Totals come from the dedupe aggregate (sum of folded copies)."""
        counts = self.rows.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("total_records"),
                               F.count(F.lit(1)).alias("processed_records"))
        out_tot = self.outliers.agg(F.coalesce(F.sum("outliers"), F.lit(0)).cast("long").alias("outliers_detected"))
        return one_row(counts, out_tot).select(
            F.col("total_records").cast("long"), F.col("processed_records").cast("long"),
            (F.col("total_records") - F.col("processed_records")).cast("long").alias("duplicates_removed"),
            F.col("outliers_detected").cast("long"))

    @cached_property
    def null_report(self) -> DataFrame:
        """Per-column null shares of the de-duplicated rows."""
        nulls = null_shares(self.__dict__.get("rows", self.distinct), self.cols)
        return self.spark.createDataFrame(
            [(i, c, nulls[c]) for i, c in enumerate(self.cols)],
            "ordinal int, column_name string, null_percentage double")

    @cached_property
    def types(self) -> DataFrame:
        """Inferred types."""
        return self.spark.createDataFrame([(i, c, self.info["kinds"][c]) for i, c in enumerate(self.cols)],
                                          "ordinal int, column_name string, inferred_type string")


def clean(df: DataFrame, order_by=None, approx: bool = False, checkpoint: bool = True,
          now: Column | None = None) -> Cleaned:
    """C1-C15 over an upload DataFrame; see :class:`Cleaned`."""
    return Cleaned(df, order_by, approx, checkpoint, now)
