"""Report contents (S8, S9) as tables; styling and rendering are not built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules


def report_sample(df: DataFrame, order_by: list, n: int = rules.REPORT_SAMPLE_ROWS) -> DataFrame:
    """The first ``n`` records in a stable order (top-k, no full sort)."""
    return df.orderBy(*order_by).limit(n)


def _cut(c: Column) -> Column:
    k = rules.REPORT_CELL_CHARS
    return (F.when(c.isNull() | (c == ""), F.lit("N/A"))
             .when(F.length(c) > k, F.concat(F.substring(c, 1, k), F.lit("..")))
             .otherwise(c))


def _num_or_na(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("N/A")).otherwise(c.cast("string"))


def profile_section(prof: DataFrame) -> DataFrame:
    """The profile table of the reports (min/max cut to 18 chars + '..')."""
    return prof.select(
        "ordinal", "column_name", "data_type", "semantic_type", "null_percentage", "distinct_count",
        _cut(F.col("min_value")).alias("min_value"), _cut(F.col("max_value")).alias("max_value"),
        _num_or_na(F.col("mean_value")).alias("mean_value"), _num_or_na(F.col("median_value")).alias("median_value"),
        _num_or_na(F.col("std_dev_value")).alias("std_dev_value"))


def header_section(domain: DataFrame, records: DataFrame, kpis: DataFrame, insights: DataFrame) -> DataFrame:
    """Header counts.  Output (one row): domain, confidence_score,
    record_count (thousands-separated), kpi_count, insight_count."""
    from .profile import one_row
    k = kpis.agg(F.count(F.lit(1)).alias("kpi_count"))
    i = insights.agg(F.count(F.lit(1)).alias("insight_count"))
    return one_row(domain, records, k, i).select(
        "domain", "confidence_score", F.format_number(F.col("n"), 0).alias("record_count"),
        "kpi_count", "insight_count")
