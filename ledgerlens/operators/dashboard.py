"""Dashboard queries (A1-A10).

The reference sends one SQL statement per KPI and one per numeric column
for skewness.  Here all KPI formulas of a dataset are folded into one
aggregate and all skewness columns into another: one scan each, partial
aggregation on the map side, a single-row final stage.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import exprs, rules
from .profile import one_row


def _kpi_display(value: Column, dtype: T.DataType, formula: str) -> Column:
    """A2: text shown for a KPI value of a given result type."""
    if isinstance(dtype, exprs.INTEGRAL_TYPES):
        shown = exprs.grouped(value, 0)
    elif isinstance(dtype, exprs.NUMERIC_TYPES):
        money = (("SUM" in formula or "AVG" in formula)
                 and any(w in formula.lower() for w in rules.MONEY_WORDS))
        shown = exprs.grouped(value, 2)
        if money:
            shown = F.concat(F.lit("$"), shown)
    else:
        shown = value.cast("string")
    return F.when(value.isNull(), F.lit("0")).otherwise(shown)


def evaluate_kpis(df: DataFrame, kpis) -> DataFrame:
    """A1 + A2: evaluate KPI formulas in one aggregate.

    ``kpis`` is a list of (name, formula) pairs or a DataFrame with
    ``kpi_name`` and ``formula`` (at most a handful of rows per dataset).
    A formula that does not analyse against ``df`` yields "Error".
    Output: kpi_order, kpi_name, formula, value (display text), raw_value.
    """
    if isinstance(kpis, DataFrame):
        kpis = [(r["kpi_name"], r["formula"]) for r in
                kpis.select("kpi_name", "formula", "kpi_order").orderBy("kpi_order").collect()]
    aggs, parts = [], []
    for i, (name, formula) in enumerate(kpis):
        try:
            e = F.expr(formula)
            dtype = df.select(e.alias("v")).schema[0].dataType  # analysis only, no job
        except (AnalysisException, ParseException):
            parts.append(F.struct(F.lit(i).alias("kpi_order"), F.lit(name).alias("kpi_name"),
                                  F.lit(formula).alias("formula"), F.lit("Error").alias("value"),
                                  F.lit(None).cast("double").alias("raw_value")))
            continue
        aggs.append(e.alias(f"_k{i}"))
        v = F.col(f"_k{i}")
        raw = v.cast("double") if isinstance(dtype, exprs.NUMERIC_TYPES) else F.lit(None).cast("double")
        parts.append(F.struct(F.lit(i).alias("kpi_order"), F.lit(name).alias("kpi_name"),
                              F.lit(formula).alias("formula"),
                              _kpi_display(v, dtype, formula).alias("value"),
                              raw.alias("raw_value")))
    base = df.agg(*aggs) if aggs else df.sparkSession.range(1)
    return base.select(F.inline(F.array(*parts)))


def show_kpis(values: DataFrame, kpis: list[tuple[str, str, str]]) -> DataFrame:
    """A1 + A2 of values that are there already: ``values`` has one row,
    ``kpis`` are (name, formula it stands for, column).  Output as
    :func:`evaluate_kpis`."""
    parts = [F.struct(F.lit(i).alias("kpi_order"), F.lit(name).alias("kpi_name"), F.lit(formula).alias("formula"),
                      _kpi_display(F.col(c), values.schema[c].dataType, formula).alias("value"), F.col(c).cast("double").alias("raw_value"))
             for i, (name, formula, c) in enumerate(kpis)]
    return values.select(F.inline(F.array(*parts)))


def daily_series(df: DataFrame, date_col: str, measure: str,
                 days: int | None = rules.SERIES_DAYS) -> DataFrame:
    """A3 / F2: SUM(measure) by calendar day, ascending, first ``days`` days.

    Output: date ('yyyy-MM-dd'), value.
    """
    g = (df.groupBy(F.to_date(F.col(date_col)).alias("_d"))
           .agg(F.sum(measure).alias("value")))
    g = g.orderBy(F.col("_d").asc_nulls_last())
    if days is not None:
        g = g.limit(days)  # top-k: TakeOrderedAndProject, no global sort
    return g.select(F.date_format("_d", "yyyy-MM-dd").alias("date"), "value")


def top_share(df: DataFrame, category: str, measure: str, k: int) -> DataFrame:
    """A4 (k=8) / A5 (k=10): SUM(measure) by category, largest first.

    Ties on the sum are broken by category name so the top-k is stable.
    Output: name, value.
    """
    return (df.groupBy(F.col(category).alias("name"))
              .agg(F.sum(measure).alias("value"))
              .orderBy(F.col("value").desc_nulls_last(), F.col("name").asc_nulls_last())
              .limit(k))


def skewness_insights(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sample skewness of each numeric column in one aggregate.

    Output: column_name, skewness, insight (null when |skew| <= 1).
    """
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [F.skewness(x).alias(f"_s{i}"), F.count(x).alias(f"_n{i}")]
    if not aggs:
        schema = "column_name string, skewness double, insight string"
        return df.sparkSession.createDataFrame([], schema)
    parts = []
    for i, c in enumerate(columns):
        s = exprs.corrected_skewness(F.col(f"_s{i}"), F.col(f"_n{i}").cast("double"))
        parts.append(F.struct(F.lit(c).alias("column_name"), s.alias("skewness")))
    return skewness_text(df.agg(*aggs).select(F.inline(F.array(*parts))))


def skewness_text(out: DataFrame) -> DataFrame:
    """column_name, skewness with their ``insight``."""
    txt = F.format_string("%.2f", F.col("skewness"))
    pos = F.format_string(
        "The **%s** data distribution exhibits positive skewness (**%s**), "
        "indicating high concentration of values on the lower end.", F.col("column_name"), txt)
    neg = F.format_string(
        "The **%s** data distribution exhibits negative skewness (**%s**), "
        "indicating high concentration on the upper end.", F.col("column_name"), txt)
    return out.withColumn(
        "insight",
        F.when(F.col("skewness") > rules.SKEW_LIMIT, pos)
         .when(F.col("skewness") < -rules.SKEW_LIMIT, neg))


# What the text of a number can hold, NaN and infinities included.
NUMBER_TEXT_CHARS = set("0123456789+-.einfatyNIE")


def _search_predicate(schema: T.StructType, term: str) -> Column:
    # The term's % and _ stay wildcards (as in the reference); a backslash
    # is escaped so it matches itself.
    pattern = "%" + term.replace("\\", "\\\\") + "%"
    numbers = not {c.lower() for c in term} - {c.lower() for c in NUMBER_TEXT_CHARS} - {"%", "_"}
    # text columns first (no cast); number columns only if the term can be in a number's text
    fields = sorted(schema.fields, key=lambda f: not isinstance(f.dataType, T.StringType))
    preds = [exprs.as_text(exprs.sql_ident(f.name), f.dataType).ilike(pattern) for f in fields
             if numbers or not isinstance(f.dataType, exprs.NUMERIC_TYPES)]
    return F.coalesce(_any(preds), F.lit(False))


def _any(preds: list[Column]) -> Column:
    out = F.lit(False)
    for p in preds:
        out = out | p
    return out


def search_records(df: DataFrame, term: str | None) -> DataFrame:
    """Rows where any column, as text, contains ``term`` (case-insensitive)."""
    if not term:
        return df
    return df.where(_search_predicate(df.schema, term))


def match_count(df: DataFrame, term: str | None) -> DataFrame:
    """Number of rows matching A8.  Output: total."""
    return search_records(df, term).agg(F.count(F.lit(1)).alias("total"))


def page(df: DataFrame, order_by: list[str], limit: int = rules.PAGE_SIZE,
         offset: int = 0) -> DataFrame:
    """A10: one page of records in a stable order (NaN shown as null)."""
    return shown(df.orderBy(*order_by).offset(offset).limit(limit))


def shown(out: DataFrame) -> DataFrame:
    """Records as a page shows them: NaN as null."""
    fixed = []
    for f in out.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            fixed.append(F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name))
        else:
            fixed.append(F.col(f.name))
    return out.select(*fixed)


def page_count(total: Column, size: int = rules.PAGE_SIZE) -> Column:
    """Number of pages for ``total`` rows (the UI's page math)."""
    return F.ceil(total / F.lit(size)).cast("long")


def _header(filename, domain, confidence, records) -> Column:
    cells = [("filename", filename), ("domain", domain), ("confidence_score", confidence), ("record_count", records)]
    return F.inline(F.array(*[F.struct(F.lit("header").alias("section"), F.lit(i).alias("position"),
                                       F.lit(label).alias("label"), value.alias("value"))
                              for i, (label, value) in enumerate(cells, 1)]))


def dashboard_header(filename: str, domain: DataFrame, records: DataFrame) -> DataFrame:
    """A7 header rows.  ``domain``: domain, confidence_score (P8);
    ``records``: n (both one row)."""
    return one_row(domain, records).select(_header(F.lit(filename), F.col("domain"), exprs.float_text(F.col("confidence_score")),
                                                   F.col("n").cast("string")))


def empty_dashboard(spark) -> DataFrame:
    """A7 for a user without datasets: a header of defaults and one insight."""
    one = spark.range(1)
    head = one.select(_header(F.lit(rules.NO_DATASET_FILE), F.lit(rules.GENERIC_DOMAIN), F.lit("0.0"), F.lit("0")))
    return head.unionByName(one.select(F.lit("insight").alias("section"), F.lit(1).alias("position"),
                                       F.lit("").alias("label"), F.lit(rules.NO_DATASET_TEXT).alias("value")))


def dashboard_document(kpis: DataFrame, series: DataFrame, pie: DataFrame, bar: DataFrame, insights: DataFrame,
                       header: DataFrame | None = None) -> DataFrame:
    """The dashboard parts as one long table.

    Output: section, position, label, value (text) -- one row per header
    field, KPI, chart point and insight; every part is already bounded (top-k).
    """
    def w(order):  # parts are top-k bounded: a one-partition window is fine
        return F.row_number().over(Window.orderBy(*order))
    k = kpis.select(F.lit("kpi").alias("section"), F.col("kpi_order").cast("int").alias("position"),
                    F.col("kpi_name").alias("label"), F.col("value"))
    s = series.select(F.lit("line").alias("section"), w([F.col("date")]).alias("position"),
                      F.col("date").alias("label"), exprs.float_text(F.col("value")).alias("value"))
    p = pie.select(F.lit("pie").alias("section"),
                   w([F.col("value").desc(), F.col("name")]).alias("position"),
                   F.col("name").alias("label"), exprs.float_text(F.col("value")).alias("value"))
    b = bar.select(F.lit("bar").alias("section"),
                   w([F.col("value").desc(), F.col("name")]).alias("position"),
                   F.col("name").alias("label"), exprs.float_text(F.col("value")).alias("value"))
    i = insights.where(F.col("insight").isNotNull()).select(
        F.lit("insight").alias("section"), w([F.col("column_name")]).alias("position"),
        F.col("column_name").alias("label"), F.col("insight").alias("value"))
    parts = k.unionByName(s).unionByName(p).unionByName(b).unionByName(i)
    return parts if header is None else header.unionByName(parts)
