"""Dataset context document.

The document digests one dataset's profile, KPIs, charts, insights,
forecast and segments.  Every input is already an aggregate bounded by
the schema width or a top-k (columns, <= 5 KPIs, chart points, <= 4
segments), so collecting them into one text row is bounded as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import exprs
from .profile import one_row

# FIXED VALUES: section headers of the context document, in order.
HEADERS = [
    "=== DATASET INFORMATION ===",
    "=== METADATA & SCHEMA ===",
    "=== DASHBOARD KPIS & CALCULATIONS ===",
    "=== DASHBOARD VISUALIZATIONS & RANKS ===",
    "=== RULE-BASED INSIGHTS & SKEWNESS ===",
    "=== DEMAND FORECAST (ML Holt-Winters & OLS Exponents) ===",
    "=== CUSTOMER SEGMENTATION (ML K-Means Clustering) ===",
]


def column_digest(prof: DataFrame) -> DataFrame:
    """One text line per profiled column.  Output: ordinal, line."""
    stats = F.concat_ws(
        ", ",
        F.when(F.col("mean_value").isNotNull(), F.format_string("Mean: %.2f", F.col("mean_value"))),
        F.when(F.col("median_value").isNotNull(), F.format_string("Median: %.2f", F.col("median_value"))),
        F.when(F.col("distinct_count").isNotNull(),
               F.concat(F.lit("Distinct values: "), F.col("distinct_count").cast("string"))),
        F.when(F.col("null_percentage").isNotNull(),
               F.format_string("Nulls: %.1f%%", F.col("null_percentage"))))
    return prof.select("ordinal", F.format_string(
        "- Column '%s': Type=%s, Semantic=%s%s", F.col("column_name"), F.col("data_type"),
        F.col("semantic_type"),
        F.when(F.length(stats) > 0, F.concat(F.lit(" ("), stats, F.lit(")"))).otherwise(F.lit(""))
    ).alias("line"))


def chart_digest(points: DataFrame) -> DataFrame:
    """Per chart, its first five 'name: value' pairs.

    ``points``: chart_order, chart_type, title, position, label, value
    (double).  Output: chart_order, line.
    """
    first5 = points.where(F.col("position") <= 5)
    pairs = F.sort_array(F.collect_list(F.struct(
        "position", F.concat(F.col("label"), F.lit(": "), exprs.float_text(F.col("value"))).alias("p"))))
    return first5.groupBy("chart_order", "chart_type", "title").agg(pairs.alias("ps")).select(
        "chart_order", F.format_string("- %s '%s': Top values -> %s", F.col("chart_type"), F.col("title"),
                                       F.array_join(F.transform("ps", lambda x: x["p"]), ", ")).alias("line"))


def _lines(df: DataFrame, order: str, line: str, alias: str) -> DataFrame:
    return df.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line))),
                                           lambda x: x[line]), "\n").alias(alias))


def context_document(filename: str, domain: DataFrame, records: DataFrame, columns: DataFrame,
                     kpis: DataFrame, charts: DataFrame, insights: DataFrame,
                     forecast: DataFrame, segments: DataFrame, metric: str = "Sales") -> DataFrame:
    """The sections joined in their fixed order (one row: document).

    domain: domain, confidence_score; records: n; columns: ordinal, line;
    kpis: kpi_order, kpi_name, value, formula; charts: chart_order, line;
    insights: insight_order, text; forecast: one digest row (F10) with its
    ``mape``; segments: M9 rows; metric: the column that is forecast.
    """
    kp = kpis.select("kpi_order", F.format_string("- %s: %s (Formula: %s)", "kpi_name", "value",
                                                  "formula").alias("line"))
    ins = insights.select("insight_order", F.concat(F.lit("- "), F.col("text")).alias("line"))
    seg = segments.select(F.col("segment_name").alias("_o"), F.format_string(
        "- Segment '%s': Count=%s customers (%s%% of total), Average Spend/Monetary=$%s",
        F.col("segment_name"), F.col("customer_count").cast("string"),
        exprs.float_text(F.col("percentage")), exprs.grouped(F.col("avg_monetary"), 2)).alias("line"))
    fc = forecast.select(F.concat_ws(
        "\n",
        F.lit(f"- Forecast Target Metric: {metric}"),
        F.concat(F.lit("- Forecast Accuracy (MAPE): "), exprs.float_text(F.col("mape")), F.lit("%")),
        F.format_string("- Historical Data Count: %s records", F.col("history_days").cast("string")),
        F.concat(F.lit("- Average Historical Value: "), exprs.grouped(F.col("history_mean"), 2)),
        F.format_string("- 30-Day Forecast Point Count: %s days", F.col("forecast_days").cast("string")),
        F.concat(F.lit("- Total Forecasted Sum: $"), exprs.grouped(F.col("forecast_sum"), 2)),
        F.concat(F.lit("- Average Projected Day: $"), exprs.grouped(F.col("forecast_mean"), 2)),
        F.concat(F.lit("- Projected Min: $"), exprs.grouped(F.col("forecast_min"), 2),
                 F.lit(", Projected Max: $"), exprs.grouped(F.col("forecast_max"), 2))).alias("fc"))
    parts = one_row(domain, records, _lines(columns, "ordinal", "line", "cols"),
                    _lines(kp, "kpi_order", "line", "kpis"), _lines(charts, "chart_order", "line", "charts"),
                    _lines(ins, "insight_order", "line", "ins"), fc, _lines(seg, "_o", "line", "segs"))
    info = F.concat_ws("\n", F.concat(F.lit("File Name: "), F.lit(filename)),
                       F.concat(F.lit("Ingested Domain: "), F.col("domain")),
                       F.concat(F.lit("Record Count: "), F.col("n").cast("string")),
                       F.format_string("Metadata Confidence Score: %.1f%%", F.col("confidence_score")))
    body = [info, F.col("cols"), F.coalesce(F.col("kpis"), F.lit("- No computed KPIs exist.")),
            F.coalesce(F.col("charts"), F.lit("- No charts data exist.")),
            F.coalesce(F.col("ins"), F.lit("- No insights exist.")), F.col("fc"),
            F.coalesce(F.col("segs"), F.lit("- Customer segment clusters are unassigned."))]
    pieces = []
    for h, b in zip(HEADERS, body):
        pieces += [F.lit(h), F.coalesce(b, F.lit("")), F.lit("")]
    return parts.select(F.concat_ws("\n", *pieces).alias("document"))
