"""Registered queries (one per operator of the inventory) and their DuckDB twins.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables.
Computed money values are rounded to 2 decimals and statistics to 6 in
both the Spark query and its SQL twin, so the comparison does not hinge on
the order in which floating-point sums were added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .functions import exprs, rules
from .operators import dashboard as dash
from .plans import rollup
from .plans.star import own_column, sales_lines, sales_lines_sql
from .session import stage
from .sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def r2(c):
    return F.round(c, 2)


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- dashboard
KPI_COLS = ["net_amount", "unit_price", "quantity", "customer_id"]
KPIS = [("Total Net Amount", "SUM(net_amount)"), ("Total Unit Price", "SUM(unit_price)"),
        ("Total Quantity", "SUM(quantity)"), ("Total Records Volume", "COUNT(customer_id)")]


@register("a1_kpi_values", f"""
WITH f AS {sales_lines_sql(KPI_COLS)},
a AS (SELECT sum(net_amount) k0, sum(unit_price) k1, sum(quantity) k2, count(customer_id) k3 FROM f)
SELECT 0 AS kpi_order, 'Total Net Amount' AS kpi_name, 'SUM(net_amount)' AS formula,
       coalesce(format('{{:,.2f}}', k0), '0') AS value, round(k0, 2) AS raw_value FROM a
UNION ALL SELECT 1, 'Total Unit Price', 'SUM(unit_price)', coalesce('$' || format('{{:,.2f}}', k1), '0'), round(k1, 2) FROM a
UNION ALL SELECT 2, 'Total Quantity', 'SUM(quantity)', coalesce(format('{{:,.2f}}', k2), '0'), round(k2, 2) FROM a
UNION ALL SELECT 3, 'Total Records Volume', 'COUNT(customer_id)', format('{{:,}}', k3), CAST(k3 AS DOUBLE) FROM a
""")
def a1_kpi_values(spark, sf_dir):
    flat = sales_lines(Tables(spark, sf_dir), KPI_COLS)
    return dash.evaluate_kpis(flat, KPIS).withColumn("raw_value", r2("raw_value"))


@register("a3_daily_series", f"""
SELECT strftime(CAST(order_date AS DATE), '%Y-%m-%d') AS date, CAST(round(sum(CAST(net_amount AS DECIMAL(38,4))), 2) AS DOUBLE) AS value
FROM {sales_lines_sql(["order_date", "net_amount"])} f
GROUP BY CAST(order_date AS DATE) ORDER BY CAST(order_date AS DATE) LIMIT 100
""")
def a3_daily_series(spark, sf_dir):
    # SUM is pushed below the joins: lines -> per-order sums -> orders
    sums = rollup.sum_by(Tables(spark, sf_dir), "order_date", "net_amount")
    return dash.daily_series(sums, "order_date", "value").withColumn("value", r2("value").cast("double"))


@register("a4_category_share", f"""
SELECT category_name AS name, CAST(round(sum(CAST(net_amount AS DECIMAL(38,4))), 2) AS DOUBLE) AS value
FROM {sales_lines_sql(["category_name", "net_amount"])} f
GROUP BY category_name ORDER BY sum(net_amount) DESC, name LIMIT 8
""")
def a4_category_share(spark, sf_dir):
    sums = rollup.sum_by(Tables(spark, sf_dir), "category_name", "net_amount")
    return dash.top_share(sums, "category_name", "value", rules.PIE_TOP).withColumn(
        "value", r2("value").cast("double"))


@register("a5_country_ranking", f"""
SELECT country AS name, CAST(round(sum(CAST(net_amount AS DECIMAL(38,4))), 2) AS DOUBLE) AS value
FROM {sales_lines_sql(["country", "net_amount"])} f
GROUP BY country ORDER BY sum(net_amount) DESC, name LIMIT 10
""")
def a5_country_ranking(spark, sf_dir):
    sums = rollup.sum_by(Tables(spark, sf_dir), "country", "net_amount")
    return dash.top_share(sums, "country", "value", rules.BAR_TOP).withColumn("value", r2("value").cast("double"))


SKEW_COLS = ["order_number", "line_number", "quantity", "net_amount", "unit_price", "discount"]


def _skew_sql() -> str:
    parts = []
    for c in SKEW_COLS:
        parts.append(f"SELECT '{c}' AS column_name, skewness({c}) AS s FROM f")
    return f"""
WITH f AS {sales_lines_sql(SKEW_COLS)}, k AS ({' UNION ALL '.join(parts)})
SELECT column_name, round(s, 6) AS skewness,
  CASE WHEN s > 1.0 THEN 'The **' || column_name || '** data distribution exhibits positive skewness (**'
            || printf('%.2f', s) || '**), indicating high concentration of values on the lower end.'
       WHEN s < -1.0 THEN 'The **' || column_name || '** data distribution exhibits negative skewness (**'
            || printf('%.2f', s) || '**), indicating high concentration on the upper end.' END AS insight
FROM k"""


@register("a6_skewness_insights", _skew_sql())
def a6_skewness_insights(spark, sf_dir):
    flat = sales_lines(Tables(spark, sf_dir), SKEW_COLS)
    return dash.skewness_insights(flat, SKEW_COLS).withColumn("skewness", r6("skewness"))


SEARCH_COLS = ["order_number", "line_number", "product_name", "category_name", "brand",
               "quantity", "return_flag"]
SEARCH_TERM = "ring"


def _search_where(cols, term):
    return " OR ".join(f"CAST({c} AS VARCHAR) ILIKE '%{term}%'" for c in cols)


@register("a8_record_search", f"""
SELECT * FROM {sales_lines_sql(SEARCH_COLS)} f WHERE {_search_where(SEARCH_COLS, SEARCH_TERM)}
""")
def a8_record_search(spark, sf_dir):
    flat = sales_lines(Tables(spark, sf_dir), SEARCH_COLS)
    return dash.search_records(flat, SEARCH_TERM)


@register("a9_match_count", f"""
SELECT count(*) AS total FROM {sales_lines_sql(SEARCH_COLS)} f WHERE {_search_where(SEARCH_COLS, SEARCH_TERM)}
""")
def a9_match_count(spark, sf_dir):
    flat = sales_lines(Tables(spark, sf_dir), SEARCH_COLS)
    return dash.match_count(flat, SEARCH_TERM)


@register("a10_records_page", f"""
SELECT * FROM {sales_lines_sql(SEARCH_COLS)} f WHERE {_search_where(SEARCH_COLS, SEARCH_TERM)}
ORDER BY ALL LIMIT 50 OFFSET 100
""")
def a10_records_page(spark, sf_dir):
    flat = sales_lines(Tables(spark, sf_dir), SEARCH_COLS)
    # ORDER BY every column: the page order is total, so pages are stable
    return dash.page(dash.search_records(flat, SEARCH_TERM), SEARCH_COLS,
                     limit=rules.PAGE_SIZE, offset=100)


# ---------------------------------------------------------------- record index
from .operators import record_index  # noqa: E402
from .session import shared_dir  # noqa: E402

_PAGE_ORDER = ", ".join(f"{c} NULLS FIRST" for c in SEARCH_COLS)


def _record_index(spark, sf_dir, search):
    import uuid

    flat = sales_lines(Tables(spark, sf_dir), SEARCH_COLS)
    return record_index.build(flat, SEARCH_COLS, shared_dir(spark, f"index/{uuid.uuid4().hex}"), search=search)


@register("a10_deep_page", f"""
SELECT {', '.join(SEARCH_COLS)} FROM (SELECT *, row_number() OVER (ORDER BY {_PAGE_ORDER}) AS k, count(*) OVER () AS n
FROM {sales_lines_sql(SEARCH_COLS)} f) WHERE k > n // 10 * 9 AND k <= n // 10 * 9 + 50""")
def a10_deep_page(spark, sf_dir):
    """The page that starts after nine tenths of all lines, by the rank directory."""
    index = _record_index(spark, sf_dir, False)
    n = index.directory().agg(F.sum("n")).first()[0] or 0
    return index.page(offset=n // 10 * 9)


INDEXED_TERM = "red%dget"


@register("a8_indexed_search", f"""
SELECT * FROM {sales_lines_sql(SEARCH_COLS)} f WHERE {_search_where(SEARCH_COLS, INDEXED_TERM)}
UNION ALL SELECT * FROM {sales_lines_sql(SEARCH_COLS)} f WHERE {_search_where(SEARCH_COLS, 'hot gear')}""")
def a8_indexed_search(spark, sf_dir):
    """Two searches by posting lists, one with wildcards."""
    index = _record_index(spark, sf_dir, True)
    return index.search(INDEXED_TERM).unionByName(index.search("hot gear"))


# ---------------------------------------------------------------- profile
from .operators import profile as prof_ops  # noqa: E402
from .plans import twins  # noqa: E402
from .plans.star import FLAT_COLUMNS  # noqa: E402

FLAT_KINDS = {
    "order_number": "Integer", "line_number": "Integer", "order_date": "DateTime",
    "customer_id": "Integer", "quantity": "Float", "net_amount": "Float", "unit_price": "Float",
    "discount": "Float", "ship_date": "DateTime",
}
ORDERS_KINDS = [("o_orderkey", "Integer"), ("o_custkey", "Integer"), ("o_orderstatus", "Text"),
                ("o_totalprice", "Float"), ("o_orderdate", "DateTime"), ("o_orderpriority", "Text")]
STAT_COLS = ["mean_value", "median_value", "std_dev_value"]


def _round_stats(df):
    return df.select(*[r6(c).alias(c) if c in STAT_COLS else F.col(c) for c in df.columns])


def _round_stats_sql(inner: str) -> str:
    return ("SELECT ordinal, column_name, data_type, semantic_type, null_percentage, distinct_count, "
            "cardinality, min_value, max_value, round(mean_value, 6) AS mean_value, "
            "round(median_value, 6) AS median_value, round(std_dev_value, 6) AS std_dev_value "
            f"FROM ({inner})")


def _flat_profile_sql() -> str:
    cols = [(c, FLAT_KINDS.get(c, "Text")) for c in FLAT_COLUMNS]
    return twins.profile_sql(f"{sales_lines_sql(FLAT_COLUMNS)} f", cols)


def _flat_profile(spark, sf_dir):
    return prof_ops.profile(sales_lines(Tables(spark, sf_dir, wide=True)), materialize=True)


def _flat_metadata(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return prof_ops.column_metadata(sales_lines(t), sales_lines(t, reading=prof_ops.value_codes), lambda c: own_column(t, c))


@register("p1_p7_profile_orders",
          _round_stats_sql(twins.profile_sql("orders", ORDERS_KINDS)))
def p1_p7_profile_orders(spark, sf_dir):
    return _round_stats(prof_ops.profile(Tables(spark, sf_dir, wide=True).orders))


@register("p1_p7_profile_sales", _round_stats_sql(_flat_profile_sql()))
def p1_p7_profile_sales(spark, sf_dir):
    return _round_stats(_flat_profile(spark, sf_dir))


def _incremental_sql() -> str:
    prof = twins.profile_sql("orders", ORDERS_KINDS)
    return f"""SELECT ordinal, column_name, data_type, semantic_type, null_percentage, min_value, max_value,
  round(mean_value, 6) AS mean_value, round(std_dev_value, 6) AS std_dev_value, true AS distinct_within, true AS median_within
FROM ({prof})"""


@register("p_incremental_profile", _incremental_sql())
def p_incremental_profile(spark, sf_dir):
    """Orders appended in three parts, each profiled alone and merged; whether
    the two sketched figures are within 3 % and 2 % (of the ranks) of the exact ones."""
    import uuid

    from .sources import catalog

    orders, root = Tables(spark, sf_dir).orders, shared_dir(spark, f"catalog-{uuid.uuid4().hex}")
    for k in range(3):
        catalog.append_rows(orders.where(F.pmod("o_orderkey", F.lit(3)) == k), root, "orders")
    prof = catalog.stored_metadata(spark, root, "column_metadata", "orders", "cleaned")
    whole = catalog.read_parts(spark, root, "orders")
    found = prof.collect()  # one row a column
    exact = prof_ops.distinct_counts(whole, {r["ordinal"]: exprs.sql_ident(r["column_name"]) for r in found})
    numbers = [r for r in found if r["median_value"] is not None]
    below = whole.agg(F.count(F.lit(1)).alias("n"), *[x.alias(f"{k}{r['ordinal']}") for r in numbers for k, x in (
        ("l", F.count_if(F.col(r["column_name"]) < r["median_value"])), ("u", F.count_if(F.col(r["column_name"]) <= r["median_value"])))]).first()
    ok = {r["ordinal"]: below[f"l{r['ordinal']}"] <= 0.52 * below["n"] and below[f"u{r['ordinal']}"] >= 0.48 * below["n"] for r in numbers}
    rows = [(r["ordinal"], abs(r["distinct_count"] - exact[r["ordinal"]]) <= 0.03 * exact[r["ordinal"]] + 1, ok.get(r["ordinal"], True))
            for r in found]
    judged = spark.createDataFrame(rows, "ordinal int, distinct_within boolean, median_within boolean")
    return prof.join(F.broadcast(judged), "ordinal").select(
        "ordinal", "column_name", "data_type", "semantic_type", "null_percentage", "min_value", "max_value",
        r6("mean_value").alias("mean_value"), r6("std_dev_value").alias("std_dev_value"), "distinct_within", "median_within")


@register("p8_domain", f"WITH prof AS ({_flat_profile_sql()}) {twins.domain_sql('prof')}")
def p8_domain(spark, sf_dir):
    return prof_ops.classify_domain(prof_ops.column_names(sales_lines(Tables(spark, sf_dir))))


@register("p9_kpi_suggestions", f"WITH prof AS ({_flat_profile_sql()}) {twins.kpis_sql('prof')}")
def p9_kpi_suggestions(spark, sf_dir):
    return prof_ops.suggest_kpis(_flat_metadata(spark, sf_dir))


@register("p10_chart_suggestions", f"WITH prof AS ({_flat_profile_sql()}) {twins.charts_sql('prof')}")
def p10_chart_suggestions(spark, sf_dir):
    return prof_ops.suggest_charts(_flat_metadata(spark, sf_dir))


@register("p11_column_picks", f"WITH prof AS ({_flat_profile_sql()}) {twins.picks_sql('prof')}")
def p11_column_picks(spark, sf_dir):
    return prof_ops.pick_columns(_flat_metadata(spark, sf_dir))


@register("p12_p13_ingest_insights", f"""
WITH prof AS ({_flat_profile_sql()}), d AS ({twins.domain_sql('prof')}),
n AS (SELECT count(*) AS n FROM {sales_lines_sql(FLAT_COLUMNS)} f),
info AS (SELECT count(*) AS ncols,
         list(column_name ORDER BY ordinal) FILTER (WHERE null_percentage > {rules.NULL_WARN_PCT}) AS nulls FROM prof)
SELECT 0 AS insight_order, 'Successfully identified dataset domain as **' || domain || '** with **'
       || CAST(confidence_score AS VARCHAR) || '%** confidence.' AS text FROM d
UNION ALL SELECT 1, 'Ingested **' || format('{{:,}}', n) || '** records across **' || CAST(ncols AS VARCHAR)
       || '** distinct column fields.' FROM n, info
UNION ALL SELECT 2, '**WARNING**: Columns (' || array_to_string(nulls[1:{rules.NULL_WARN_NAMES}], ', ')
       || ') contain high missing value percentages. Mode/median substitution applied.'
  FROM info WHERE len(coalesce(nulls, [])) > 0
""")
def p12_p13_ingest_insights(spark, sf_dir):
    flat = stage(sales_lines(Tables(spark, sf_dir, wide=True)), "sales-lines")
    prof = prof_ops.profile(flat)
    return prof_ops.ingest_insights(prof, prof_ops.classify_domain(prof),
                                    flat.agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- cleaning
from .operators import clean as clean_ops  # noqa: E402
from .plans import dirty  # noqa: E402

_BOOL_TOKENS_SQL = ", ".join(twins.q(t) for t in rules.BOOL_INFER_TOKENS)
_TRUE_SQL = ", ".join(twins.q(t) for t in rules.BOOL_TRUE_TOKENS)
_FALSE_SQL = ", ".join(twins.q(t) for t in rules.BOOL_FALSE_TOKENS)
_NULLTOK_SQL = ", ".join(twins.q(t) for t in rules.TEXT_NULL_TOKENS)
_SQL_DATE_FORMATS = ["%m/%d/%Y", "%m/%d/%Y %H:%M:%S", "%Y/%m/%d", "%d-%b-%Y", "%b %-d, %Y", "%-d %b %Y",
                     "%m/%d/%Y %H:%M", "%B %-d, %Y", "%-d %B %Y", "%d/%m/%Y", "%d/%m/%Y %H:%M", "%d/%m/%Y %H:%M:%S"]


def _pdate(c):
    s = f"trim(CAST({c} AS VARCHAR))"
    tries = [f"CASE WHEN regexp_matches({s}, {twins.q(clean_ops.ISO_DATE_SHAPE)}) THEN TRY_CAST({s} AS TIMESTAMP) END"]
    tries += [f"CASE WHEN regexp_matches({s}, {twins.q(shape)}) THEN try_strptime({s}, '{f}') END"
              for (shape, _), f in zip(clean_ops.DATE_FORMATS, _SQL_DATE_FORMATS)]
    return f"coalesce({', '.join(tries)})"


def _pbool(c):
    t = f"lower(trim(CAST({c} AS VARCHAR)))"
    return f"(CASE WHEN {t} IN ({_TRUE_SQL}) THEN true WHEN {t} IN ({_FALSE_SQL}) THEN false END)"


def _ptext(c):
    t = f"trim(CAST({c} AS VARCHAR))"
    return f"(CASE WHEN {t} NOT IN ({_NULLTOK_SQL}) THEN {t} END)"


_DIRTY_CTE = f"raw AS {dirty.upload_lines_sql()}, dd AS (SELECT DISTINCT * FROM raw)"
_INTEGER_COLS = ["order_number", "line_number", "product_code", "supplier_code", "quantity"]
_FLOAT_COLS = ["unit_price", "discount"]
_KEY_SQL = ", ".join(f"CAST({c} AS BIGINT)" for c in dirty.ORDER_KEY)


def _cleaned_sql() -> str:
    num = _INTEGER_COLS + _FLOAT_COLS
    meds = ", ".join(f"quantile_cont({twins.parse_sql(c)}, 0.5) AS m_{c}" for c in num)
    mode_cat = (f"(SELECT v FROM (SELECT {_ptext('category_name')} AS v, count(*) AS n FROM dd "
                f"WHERE {_ptext('category_name')} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)")
    mode_line = (f"(SELECT v FROM (SELECT {_ptext('line_status')} AS v, count(*) AS n FROM dd "
                 f"WHERE {_ptext('line_status')} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)")
    mode_ret = (f"(SELECT v FROM (SELECT {_pbool('is_returned')} AS v, count(*) AS n FROM dd "
                f"WHERE {_pbool('is_returned')} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)")
    sel = []
    for c in _INTEGER_COLS:
        sel.append(f"CAST(coalesce({twins.parse_sql(c)}, m_{c}, 0.0) AS DOUBLE) AS {c}")
    for c in _FLOAT_COLS:
        sel.append(f"{exprs.np_round_sql(f'CAST(coalesce({twins.parse_sql(c)}, m_{c}, 0.0) AS DOUBLE)', 4)} AS {c}")
    sel.append(f"{_pdate('ship_date')} AS ship_raw")
    sel.append(f"coalesce({_ptext('category_name')}, {mode_cat}, 'Unknown') AS category_name")
    sel.append(f"coalesce({_pbool('is_returned')}, {mode_ret}, true) AS is_returned")
    sel.append(f"coalesce({_ptext('line_status')}, {mode_line}, 'Unknown') AS line_status")
    sel.append(f"{_KEY_SQL.replace('CAST(', 'CAST(dd.')} ")
    keys = ", ".join(f"k{i}" for i in range(len(dirty.ORDER_KEY)))
    key_sel = ", ".join(f"CAST(dd.{c} AS BIGINT) AS k{i}" for i, c in enumerate(dirty.ORDER_KEY))
    sel[-1] = key_sel
    return f"""WITH {_DIRTY_CTE}, med AS (SELECT {meds} FROM dd),
typed AS (SELECT {', '.join(sel)} FROM dd, med)
SELECT order_number, line_number, product_code, supplier_code,
  coalesce(ship_raw,
           last_value(ship_raw IGNORE NULLS) OVER (ORDER BY {keys} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           first_value(ship_raw IGNORE NULLS) OVER (ORDER BY {keys} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    AS ship_date,
  category_name, quantity, unit_price, discount, is_returned, line_status,
  quantity * unit_price AS net_amount
FROM typed"""


def _clean(spark, sf_dir):
    up = dirty.upload_lines(Tables(spark, sf_dir, wide=True))
    return clean_ops.clean(up, order_by=dirty.order_key_exprs())


@register("c1_dedupe", f"WITH {_DIRTY_CTE} SELECT * FROM dd")
def c1_dedupe(spark, sf_dir):
    up = dirty.upload_lines(Tables(spark, sf_dir))
    return clean_ops.dedupe(up).drop("_ord", "_copies")


@register("c2_null_report", f"WITH {_DIRTY_CTE} " + " UNION ALL ".join(
    f"SELECT {i} AS ordinal, '{c}' AS column_name, "
    f"{exprs.np_round_sql(f'count_if({c} IS NULL) / count(*) * 100.0', 2)} AS null_percentage FROM dd"
    for i, c in enumerate(dirty.UPLOAD_COLUMNS)))
def c2_null_report(spark, sf_dir):
    return _clean(spark, sf_dir).null_report


def _infer_sql(i, c):
    p = twins.parse_sql(c)
    return (f"SELECT {i} AS ordinal, '{c}' AS column_name, CASE WHEN count({c}) = 0 THEN 'Text' "
            f"WHEN count({p}) > count({c}) * {rules.PARSE_SHARE} THEN "
            f"(CASE WHEN count_if({p} % 1 <> 0) = 0 THEN 'Integer' ELSE 'Float' END) "
            f"WHEN count({_pdate(c)}) > count({c}) * {rules.PARSE_SHARE} THEN 'DateTime' "
            f"WHEN count_if({c} IS NOT NULL AND lower(trim({c})) NOT IN ({_BOOL_TOKENS_SQL})) = 0 THEN 'Boolean' "
            f"ELSE 'Text' END AS inferred_type FROM dd")


@register("c3_inferred_types", f"WITH {_DIRTY_CTE} " + " UNION ALL ".join(
    _infer_sql(i, c) for i, c in enumerate(dirty.UPLOAD_COLUMNS)))
def c3_inferred_types(spark, sf_dir):
    return _clean(spark, sf_dir).types


_NATIVE_SQL = ("CASE WHEN count({c}) = 0 THEN 'Text' WHEN any_value(typeof({c})) IN ('BIGINT', 'INTEGER') THEN 'Integer' "
               "WHEN any_value(typeof({c})) = 'DOUBLE' THEN 'Float' WHEN any_value(typeof({c})) LIKE 'TIMESTAMP%' THEN 'DateTime' "
               "WHEN any_value(typeof({c})) = 'BOOLEAN' THEN 'Boolean' ELSE 'other' END")
_NATIVE_COLS = ["o_orderkey", "o_totalprice", "o_orderdate", "is_open", "nothing"]


@register("c3a_native_types", "WITH t AS (SELECT *, o_orderstatus = 'O' AS is_open, CAST(NULL AS DOUBLE) AS nothing FROM orders) "
          + " UNION ALL ".join(f"SELECT {i} AS ordinal, '{c}' AS column_name, {_NATIVE_SQL.format(c=c)} AS inferred_type FROM t"
                               for i, c in enumerate(_NATIVE_COLS)))
def c3a_native_types(spark, sf_dir):
    """Inference over typed columns (and one that is all null)."""
    orders = Tables(spark, sf_dir).orders.withColumns({"is_open": F.col("o_orderstatus") == "O", "nothing": F.lit(None).cast("double")})
    return clean_ops.clean(orders.select(*_NATIVE_COLS)).types


@register("c4_c14_cleaned_dataset", _cleaned_sql())
def c4_c14_cleaned_dataset(spark, sf_dir):
    return _clean(spark, sf_dir).data


def _outlier_sql() -> str:
    num = _INTEGER_COLS + _FLOAT_COLS
    parts = []
    for c in num:
        parts.append(f"""SELECT '{c}' AS column_name, q[1] AS q1, q[2] AS q3,
  (SELECT count_if({c} < q[1] - 1.5 * (q[2] - q[1]) OR {c} > q[2] + 1.5 * (q[2] - q[1])) FROM cl) AS outliers
  FROM (SELECT quantile_cont({c}, [0.25, 0.75]) AS q FROM cl)""")
    return f"WITH cl AS ({_cleaned_sql()}) " + " UNION ALL ".join(parts)


@register("c7_outliers", _outlier_sql())
def c7_outliers(spark, sf_dir):
    return _clean(spark, sf_dir).outliers


@register("c15_cleaning_report", f"""WITH o AS ({_outlier_sql()}), {_DIRTY_CTE}
SELECT (SELECT count(*) FROM raw) AS total_records, (SELECT count(*) FROM dd) AS processed_records,
       (SELECT count(*) FROM raw) - (SELECT count(*) FROM dd) AS duplicates_removed,
       (SELECT CAST(sum(outliers) AS BIGINT) FROM o) AS outliers_detected""")
def c15_cleaning_report(spark, sf_dir):
    return _clean(spark, sf_dir).report


# ---------------------------------------------------------------- segmentation
from .operators import forecast as fc  # noqa: E402
from .operators import segment as seg_ops  # noqa: E402

_RFM_SQL = """per AS (SELECT o_custkey AS customer_code, max(o_orderdate) AS last_date, count(*) AS frequency,
                    sum(o_totalprice) AS monetary FROM orders GROUP BY o_custkey),
rfm AS (SELECT customer_code, last_date, frequency, monetary,
   CAST(floor((epoch_us((SELECT max(last_date) FROM per)) - epoch_us(last_date)) / 86400000000) AS BIGINT) AS recency
   FROM per)"""
_RULE_SQL = f"""rs AS (SELECT *, CASE WHEN frequency >= {rules.RULE_CHAMPION_FREQ} THEN 'Champions'
   WHEN recency > {rules.RULE_AT_RISK_DAYS} THEN 'At-Risk' ELSE 'Loyal Customers' END AS segment FROM rfm)"""


def _rfm(spark, sf_dir):
    return seg_ops.rfm(Tables(spark, sf_dir).orders, "o_custkey", "o_totalprice", "o_orderdate")


@register("m2_m3_rfm", f"""WITH {_RFM_SQL}
SELECT customer_code, strftime(last_date, '%Y-%m-%d %H:%M:%S') AS last_date, frequency,
       round(monetary, 2) AS monetary, recency FROM rfm""")
def m2_m3_rfm(spark, sf_dir):
    r = _rfm(spark, sf_dir)
    return r.select("customer_code", F.date_format("last_date", "yyyy-MM-dd HH:mm:ss").alias("last_date"),
                    "frequency", r2("monetary").alias("monetary"), "recency")


@register("m7_rule_segments", f"""WITH {_RFM_SQL}, {_RULE_SQL}
SELECT customer_code, recency, frequency, round(monetary, 2) AS monetary, segment FROM rs""")
def m7_rule_segments(spark, sf_dir):
    s = seg_ops.rule_segments(_rfm(spark, sf_dir))
    return s.select("customer_code", "recency", "frequency", r2("monetary").alias("monetary"), "segment")


@register("m9_rule_segment_summary", f"""WITH {_RFM_SQL}, {_RULE_SQL}
SELECT segment AS segment_name, count(*) AS customer_count,
       {exprs.np_round_sql('avg(monetary)', 2)} AS avg_monetary,
       {exprs.np_round_sql('count(*) / sum(count(*)) OVER () * 100.0', 2)} AS percentage
FROM rs GROUP BY segment""")
def m9_rule_segment_summary(spark, sf_dir):
    return seg_ops.segment_summary(seg_ops.rule_segments(_rfm(spark, sf_dir)))


@register("a11_scatter_points", f"""WITH {_RFM_SQL}, {_RULE_SQL}
SELECT customer_code, frequency AS x, round(monetary, 2) AS y, segment FROM rs""")
def a11_scatter_points(spark, sf_dir):
    s = seg_ops.scatter_points(seg_ops.rule_segments(_rfm(spark, sf_dir)))
    return s.withColumn("y", r2("y"))


@register("m4_zscores", f"""WITH {_RFM_SQL},
st AS (SELECT avg(recency) mr, stddev_pop(recency) sr, avg(frequency) mf, stddev_pop(frequency) sf,
              avg(monetary) mm, stddev_pop(monetary) sm FROM rfm)
SELECT customer_code, round((recency - mr) / sr, 6) AS z_recency, round((frequency - mf) / sf, 6) AS z_frequency,
       round((monetary - mm) / sm, 6) AS z_monetary FROM rfm, st""")
def m4_zscores(spark, sf_dir):
    z = seg_ops.standardize(_rfm(spark, sf_dir))
    return z.select("customer_code", *[r6(f"z_{c}").alias(f"z_{c}") for c in seg_ops.FEATURES])


# four centres in z-space, given: what assignment, labels and shares make of them is plain SQL
FIXED_CENTRES = [(-0.5, -0.5, -0.5), (-0.5, 1.0, 1.0), (2.0, -1.0, -1.0), (0.5, 0.0, 0.25)]


def _fixed_sql() -> str:
    far = lambda c: " + ".join(f"(z{d} - ({x})) * (z{d} - ({x}))" for d, x in zip("rfm", c))
    pts = ", ".join(f"{{'d': 0.0 + {far(c)}, 'i': {i}}}" for i, c in enumerate(FIXED_CENTRES))
    names = ", ".join(twins.q(x) for x in rules.SEGMENT_LABELS)
    return f"""WITH {_RFM_SQL},
st AS (SELECT avg(recency) mr, stddev_pop(recency) sr, avg(frequency) mf, stddev_pop(frequency) sf,
              avg(monetary) mm, stddev_pop(monetary) sm FROM rfm),
z AS (SELECT customer_code, recency, frequency, monetary, (recency - mr) / sr AS zr, (frequency - mf) / sf AS zf,
             (monetary - mm) / sm AS zm FROM rfm, st),
c AS (SELECT *, list_min([{pts}]).i AS cluster FROM z),
k AS (SELECT cluster, row_number() OVER (ORDER BY avg(monetary) DESC, cluster) AS place FROM c GROUP BY cluster),
s AS (SELECT c.*, [{names}][place] AS segment FROM c JOIN k USING (cluster))"""


@register("m5_m8_fixed_centres", f"""{_fixed_sql()}
SELECT customer_code, recency, frequency, round(monetary, 2) AS monetary, cluster, segment FROM s""")
def m5_m8_fixed_centres(spark, sf_dir):
    s = seg_ops.label_clusters(seg_ops.assign_clusters(seg_ops.standardize(_rfm(spark, sf_dir)), FIXED_CENTRES))
    return s.select("customer_code", "recency", "frequency", r2("monetary").alias("monetary"), "cluster", "segment")


@register("m9_fixed_centres_summary", f"""{_fixed_sql()}
SELECT segment AS segment_name, count(*) AS customer_count, {exprs.np_round_sql('avg(monetary)', 2)} AS avg_monetary,
       {exprs.np_round_sql('count(*) / sum(count(*)) OVER () * 100.0', 2)} AS percentage FROM s GROUP BY segment""")
def m9_fixed_centres_summary(spark, sf_dir):
    s = seg_ops.label_clusters(seg_ops.assign_clusters(seg_ops.standardize(_rfm(spark, sf_dir)), FIXED_CENTRES))
    return seg_ops.segment_summary(s)


@register("m4_m8_kmeans_segments")
def m4_m8_kmeans_segments(spark, sf_dir):
    s = seg_ops.segment_customers(Tables(spark, sf_dir).orders, "o_custkey", "o_totalprice", "o_orderdate")
    return s.withColumn("monetary", r2("monetary"))


@register("m9_kmeans_segment_summary")
def m9_kmeans_segment_summary(spark, sf_dir):
    return seg_ops.segment_summary(
        seg_ops.segment_customers(Tables(spark, sf_dir).orders, "o_custkey", "o_totalprice", "o_orderdate"))


def _resolve_sql(kind: str) -> str:
    if kind == "m1":
        return f"""WITH prof AS ({_flat_profile_sql()})
SELECT coalesce(min_by(column_name, CASE WHEN semantic_type IN ('Customer_ID', 'Email') THEN ordinal END),
                min_by(column_name, ordinal)) AS customer_col,
       min_by(column_name, CASE WHEN semantic_type = 'Date' THEN ordinal END) AS date_col,
       coalesce(min_by(column_name, CASE WHEN semantic_type IN ('Monetary', 'Quantity', 'Number') THEN ordinal END),
                max_by(column_name, ordinal)) AS amount_col FROM prof"""
    return f"""WITH prof AS ({_flat_profile_sql()})
SELECT min_by(column_name, CASE WHEN semantic_type = 'Date' THEN ordinal END) AS date_col,
       min_by(column_name, CASE WHEN semantic_type IN ('Monetary', 'Quantity', 'Number') THEN ordinal END) AS value_col
FROM prof"""


@register("m1_column_resolution", _resolve_sql("m1"))
def m1_column_resolution(spark, sf_dir):
    return seg_ops.resolve_columns(_flat_metadata(spark, sf_dir))


@register("f1_column_resolution", _resolve_sql("f1"))
def f1_column_resolution(spark, sf_dir):
    return fc.resolve_columns(_flat_metadata(spark, sf_dir))


# ---------------------------------------------------------------- forecasting
def _filled_sql(table: str, date_col: str, value_col: str, series_col: str | None) -> str:
    sid = f"CAST({series_col} AS VARCHAR)" if series_col else "'all'"
    return f"""daily AS (SELECT {sid} AS sid, CAST({date_col} AS DATE) AS d, CAST(sum({value_col}) AS DOUBLE) AS y
  FROM {table} WHERE {date_col} IS NOT NULL GROUP BY 1, 2),
cal AS (SELECT sid, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM daily GROUP BY sid),
filled AS (SELECT cal.sid, cal.d, coalesce(daily.y, 0.0) AS y FROM cal LEFT JOIN daily USING (sid, d))"""


def _holt_sql(table, date_col, value_col, series_col, horizon) -> str:
    steps = fc.GRID_STEPS
    return f"""WITH RECURSIVE {_filled_sql(table, date_col, value_col, series_col)},
s AS (SELECT sid, d, y, row_number() OVER (PARTITION BY sid ORDER BY d) - 1 AS t FROM filled),
ini AS (SELECT sid, max(CASE WHEN t = 0 THEN y END) AS y0,
          coalesce(max(CASE WHEN t = 1 THEN y END), max(CASE WHEN t = 0 THEN y END)) AS y1,
          count(*) AS n, max(d) AS last_date FROM s GROUP BY sid HAVING count(*) >= {rules.HOLT_MIN_DAYS}),
g AS (SELECT ia / {float(steps)} AS alpha, ig / {float(steps)} AS beta FROM range(1, {steps}) r1(ia), range(1, {steps}) r2(ig)),
rec AS (
  SELECT ini.sid, g.alpha, g.beta, 0 AS t, ini.y0 AS l, ini.y1 - ini.y0 AS b, 0.0::DOUBLE AS sse,
         0.0::DOUBLE AS sr, 0.0::DOUBLE AS ape, 0 AS apn FROM ini, g
  UNION ALL
  SELECT r.sid, r.alpha, r.beta, r.t + 1,
    r.alpha * s.y + (1.0 - r.alpha) * (r.l + r.b),
    r.beta * ((r.alpha * s.y + (1.0 - r.alpha) * (r.l + r.b)) - r.l) + (1.0 - r.beta) * r.b,
    r.sse + (s.y - (r.l + r.b)) * (s.y - (r.l + r.b)),
    r.sr + (s.y - (r.l + r.b)),
    CASE WHEN r.t >= 1 AND s.y > 0 THEN r.ape + abs(s.y - (r.l + r.b)) / s.y ELSE r.ape END,
    CASE WHEN r.t >= 1 AND s.y > 0 THEN r.apn + 1 ELSE r.apn END
  FROM rec r JOIN s ON s.sid = r.sid AND s.t = r.t),
fin AS (SELECT rec.*, ini.n, ini.last_date,
          row_number() OVER (PARTITION BY rec.sid ORDER BY sse, alpha, beta) AS rk
        FROM rec JOIN ini ON rec.sid = ini.sid AND rec.t = ini.n),
best AS (SELECT sid, n, last_date, alpha, beta, l AS level, b AS trend,
           sqrt(greatest(sse / n - (sr / n) * (sr / n), 0.0)) AS sigma,
           CASE WHEN apn > 0 THEN ape / apn * 100.0 END AS mape_raw FROM fin WHERE rk = 1),
fut AS (SELECT sid, last_date, h, greatest(0.0, level + h * trend) AS f, {rules.Z_95} * sigma * sqrt(h) AS w
        FROM best, range(1, {horizon + 1}) hr(h))"""


def _holt_rows_select() -> str:
    return f"""SELECT sid, strftime(last_date + CAST(h AS INTEGER), '%Y-%m-%d') AS date,
  {exprs.np_round_sql('f', 2)} AS forecast, {exprs.np_round_sql('greatest(0.0, f - w)', 2)} AS lower_bound,
  {exprs.np_round_sql('f + w', 2)} AS upper_bound FROM fut"""


def _orders_filled(spark, sf_dir):
    return fc.fill_days(fc.daily_totals(Tables(spark, sf_dir).orders, "o_orderdate", "o_totalprice"))


@register("f2_f3_daily_filled", f"""WITH {_filled_sql('orders', 'o_orderdate', 'o_totalprice', None)}
SELECT sid, strftime(d, '%Y-%m-%d') AS date, round(y, 2) AS y FROM filled""")
def f2_f3_daily_filled(spark, sf_dir):
    f = _orders_filled(spark, sf_dir)
    return f.select("sid", F.date_format("d", "yyyy-MM-dd").alias("date"), r2("y").alias("y"))


@register("f4_f6_holt_forecast", _holt_sql("orders", "o_orderdate", "o_totalprice", None, 90)
          + " " + _holt_rows_select())
def f4_f6_holt_forecast(spark, sf_dir):
    return fc.holt_forecast(fc.holt_fit(_orders_filled(spark, sf_dir)), 90)


@register("f7_holt_accuracy", _holt_sql("orders", "o_orderdate", "o_totalprice", None, 90) + f"""
SELECT sid, alpha, beta, round(mape_raw, 6) AS mape_raw,
  {exprs.np_round_sql(f'least(coalesce(mape_raw, {rules.MAPE_DEFAULT}), {rules.MAPE_CAP})', 2)} AS mape FROM best""")
def f7_holt_accuracy(spark, sf_dir):
    fit = fc.holt_fit(_orders_filled(spark, sf_dir))
    return fit.select("sid", "alpha", "beta", r6("mape_raw").alias("mape_raw"),
                      exprs.np_round(F.least(F.coalesce("mape_raw", F.lit(rules.MAPE_DEFAULT)),
                                             F.lit(rules.MAPE_CAP)), 2).alias("mape"))


@register("f_events_multi_series", _holt_sql("events", "ts", "value", "event_type", 30)
          + " " + _holt_rows_select())
def f_events_multi_series(spark, sf_dir):
    filled = fc.fill_days(fc.daily_totals(Tables(spark, sf_dir).events, "ts", "value", "event_type"))
    return fc.holt_forecast(fc.holt_fit(filled), 30)


@register("f4_holt_estimated", _holt_sql("events", "ts", "value", "event_type", 30) + """
SELECT best.sid, best.n, strftime(best.last_date, '%Y-%m-%d') AS last_date, round(log10(fin.sse), 6) AS grid_error, true AS not_above_grid
FROM best JOIN fin USING (sid) WHERE fin.rk = 1""")
def f4_holt_estimated(spark, sf_dir):
    """Estimated parameters of every series against the best grid cell: the
    grid's squared error (logarithm) and whether the estimate is no worse."""
    filled = fc.fill_days(fc.daily_totals(Tables(spark, sf_dir).events, "ts", "value", "event_type"))
    est = fc.holt_estimated(filled).select("sid", "n", "last_date", "sse")
    both = est.join(fc.holt_fit(filled).select("sid", F.col("sse").alias("grid")), "sid")
    return both.select("sid", "n", F.date_format("last_date", "yyyy-MM-dd").alias("last_date"),
                       r6(F.log10("grid")).alias("grid_error"), (F.col("sse") <= F.col("grid") * (1 + 1e-9)).alias("not_above_grid"))


@register("f5_estimated_forecast")
def f5_estimated_forecast(spark, sf_dir):
    """History and forecast with estimated parameters: totals of the orders."""
    rows, _ = fc.forecast(Tables(spark, sf_dir).orders, "o_orderdate", "o_totalprice", 90, estimated=True)
    return rows


def _linear_sql(horizon: int) -> str:
    return f"""WITH {_filled_sql('orders', 'o_orderdate', 'o_totalprice', None)},
idx AS (SELECT sid, d, y, CAST(datediff('day', min(d) OVER (PARTITION BY sid), d) AS DOUBLE) AS t FROM filled),
fit AS (SELECT sid, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept, count(*) AS n,
          max(d) AS last_date FROM idx GROUP BY sid),
sig AS (SELECT i.sid, stddev_pop(i.y - (coalesce(f.intercept, i.y) + coalesce(f.slope, 0.0) * i.t)) AS sd
        FROM idx i JOIN fit f USING (sid) GROUP BY i.sid),
lf AS (SELECT fit.sid, n, last_date, coalesce(slope, 0.0) AS slope, coalesce(intercept, 0.0) AS intercept,
         CASE WHEN n <= 1 THEN {rules.OLS_SIGMA_SINGLE} ELSE sd END AS sigma FROM fit JOIN sig USING (sid)),
fut AS (SELECT sid, last_date, h, greatest(0.0, intercept + slope * CAST(n - 1 + h AS DOUBLE)) AS f,
          {rules.Z_95} * sigma AS w FROM lf, range(1, {horizon + 1}) hr(h))
{_holt_rows_select()}"""


@register("f8_linear_forecast", _linear_sql(90))
def f8_linear_forecast(spark, sf_dir):
    return fc.linear_forecast(fc.linear_fit(_orders_filled(spark, sf_dir)), 90)


@register("f9_history_and_forecast", _holt_sql("orders", "o_orderdate", "o_totalprice", None, 90) + f"""
SELECT sid, strftime(d, '%Y-%m-%d') AS date, y AS historical, CAST(NULL AS DOUBLE) AS forecast,
       CAST(NULL AS DOUBLE) AS lower_bound, CAST(NULL AS DOUBLE) AS upper_bound FROM filled
UNION ALL SELECT sid, date, NULL, forecast, lower_bound, upper_bound FROM ({_holt_rows_select()})""")
def f9_history_and_forecast(spark, sf_dir):
    rows, _ = fc.forecast(Tables(spark, sf_dir).orders, "o_orderdate", "o_totalprice", 90)
    return rows.withColumn("historical", F.col("historical"))


@register("f10_forecast_digest", _holt_sql("orders", "o_orderdate", "o_totalprice", None, 90) + f""",
rows AS (SELECT sid, y AS historical, CAST(NULL AS DOUBLE) AS forecast FROM filled
         UNION ALL SELECT sid, NULL, forecast FROM ({_holt_rows_select()}))
SELECT sid, count(historical) AS history_days, {exprs.np_round_sql('avg(historical)', 2)} AS history_mean,
  count(forecast) AS forecast_days, {exprs.np_round_sql('sum(forecast)', 2)} AS forecast_sum,
  {exprs.np_round_sql('avg(forecast)', 2)} AS forecast_mean, min(forecast) AS forecast_min,
  max(forecast) AS forecast_max FROM rows GROUP BY sid""")
def f10_forecast_digest(spark, sf_dir):
    rows, _ = fc.forecast(Tables(spark, sf_dir).orders, "o_orderdate", "o_totalprice", 90)
    return fc.digest(rows)


# ---------------------------------------------------------------- conversations
from .operators import conversations as conv_ops  # noqa: E402
from .operators import digest as digest_ops  # noqa: E402

_NUM_SQL = ("list_sort(list_distinct(list_transform(regexp_extract_all(replace(text, ',', ''), "
            "'\\b\\d+(?:\\.\\d+)?\\b'), lambda s: CAST(s AS DOUBLE))))")
_GENERIC_SQL = ", ".join(f"{float(x)}" for x in rules.GENERIC_NUMBERS)
_FALLBACK_SQL = twins.q(rules.FALLBACK_TEXT.lower())


def _turns(spark, sf_dir):
    return Tables(spark, sf_dir).conversations


@register("t1_recent_history", f"""
SELECT conv_id, turn, role, text, CAST(count(*) OVER (PARTITION BY conv_id) - rn + 1 AS INTEGER) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
WHERE rn <= {rules.HISTORY_TURNS}""")
def t1_recent_history(spark, sf_dir):
    return conv_ops.recent_history(_turns(spark, sf_dir))


@register("t2_merged_turns", """
WITH c AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL
                            AND role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS chg
           FROM conversations),
b AS (SELECT *, sum(chg) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM c)
SELECT conv_id, CAST(block AS BIGINT) AS block, min(turn) AS first_turn, max(turn) AS last_turn,
       any_value(role) AS role, string_agg(text, chr(10) ORDER BY turn) AS text
FROM b GROUP BY conv_id, block""")
def t2_merged_turns(spark, sf_dir):
    return conv_ops.merge_turns(_turns(spark, sf_dir))


@register("t3_session_activity", """
SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id""")
def t3_session_activity(spark, sf_dir):
    return conv_ops.session_activity(_turns(spark, sf_dir))


@register("t4_ordered_messages", "SELECT * FROM conversations ORDER BY conv_id, turn")
def t4_ordered_messages(spark, sf_dir):
    return conv_ops.ordered_messages(_turns(spark, sf_dir))


@register("t5_numbers", f"""
SELECT conv_id, turn, len({_NUM_SQL}) AS n_numbers,
       array_to_string(list_transform({_NUM_SQL}, lambda v: {exprs.float_text_sql('v')}), ',') AS numbers
FROM conversations""")
def t5_numbers(spark, sf_dir):
    nums = conv_ops.extract_numbers(F.col("text"))
    return _turns(spark, sf_dir).select(
        "conv_id", "turn", F.size(nums).alias("n_numbers"),
        F.array_join(F.transform(nums, lambda v: exprs.float_text(v)), ",").alias("numbers"))


@register("t6_grounding_check", f"""
WITH nums AS (SELECT conv_id, turn, unnest({_NUM_SQL}) AS value FROM conversations WHERE role = 'assistant'),
ctx AS (SELECT conv_id, value, min(turn) AS from_turn
        FROM (SELECT conv_id, turn, unnest({_NUM_SQL}) AS value FROM conversations) GROUP BY conv_id, value),
bad AS (SELECT DISTINCT n.conv_id, n.turn FROM nums n WHERE n.value NOT IN ({_GENERIC_SQL})
        AND NOT EXISTS (SELECT 1 FROM ctx c WHERE c.conv_id = n.conv_id AND abs(n.value - c.value) < {rules.GROUNDING_TOLERANCE}
                        AND c.from_turn < n.turn)),
r AS (SELECT a.conv_id, a.turn, a.text, bad.turn IS NULL AND NOT contains(lower(a.text), {_FALLBACK_SQL}) AS grounded
      FROM conversations a LEFT JOIN bad ON a.conv_id = bad.conv_id AND a.turn = bad.turn WHERE a.role = 'assistant')
SELECT conv_id, turn, grounded, CASE WHEN grounded THEN text ELSE {twins.q(rules.FALLBACK_TEXT)} END AS text FROM r""")
def t6_grounding_check(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    return conv_ops.grounding_check(turns.where(F.col("role") == "assistant"),
                                    conv_ops.conversation_context(turns))


@register("t7_fallback_flags", f"""
SELECT conv_id, turn, contains(lower(text), {_FALLBACK_SQL}) AS is_fallback FROM conversations""")
def t7_fallback_flags(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", conv_ops.is_fallback(F.col("text")).alias("is_fallback"))


def _intent_sql() -> str:
    whens = []
    for name, words in rules.INTENTS:
        cond = " OR ".join(f"contains(lower(text), {twins.q(w)})" for w in words)
        whens.append(f"WHEN {cond} THEN {twins.q(name)}")
    return "CASE " + " ".join(whens) + f" ELSE {twins.q(rules.FALLBACK_INTENT)} END"


@register("t8_intents", f"SELECT conv_id, turn, {_intent_sql()} AS intent FROM conversations WHERE role = 'user'")
def t8_intents(spark, sf_dir):
    t = _turns(spark, sf_dir).where(F.col("role") == "user")
    return t.select("conv_id", "turn", conv_ops.intent(F.col("text")).alias("intent"))


@register("t10_column_digest", f"""WITH prof AS ({_flat_profile_sql()})
SELECT ordinal, '- Column ''' || column_name || ''': Type=' || data_type || ', Semantic=' || semantic_type ||
  ' (' || concat_ws(', ', CASE WHEN mean_value IS NOT NULL THEN printf('Mean: %.2f', mean_value) END,
     CASE WHEN median_value IS NOT NULL THEN printf('Median: %.2f', median_value) END,
     'Distinct values: ' || CAST(distinct_count AS VARCHAR), printf('Nulls: %.1f%%', null_percentage)) || ')' AS line
FROM prof""")
def t10_column_digest(spark, sf_dir):
    return digest_ops.column_digest(_flat_profile(spark, sf_dir))


def _chart_points(spark, sf_dir):
    line = a3_daily_series(spark, sf_dir).select(
        F.lit(0).alias("chart_order"), F.lit("Line Chart").alias("chart_type"),
        F.lit("Net Amount Over Time").alias("title"),
        F.row_number().over(Window.orderBy("date")).alias("position"), F.col("date").alias("label"), "value")
    pie = a4_category_share(spark, sf_dir).select(
        F.lit(1).alias("chart_order"), F.lit("Pie Chart").alias("chart_type"),
        F.lit("Net Amount Split by Category Name").alias("title"),
        F.row_number().over(Window.orderBy(F.desc("value"), "name")).alias("position"),
        F.col("name").alias("label"), "value")
    bar = a5_country_ranking(spark, sf_dir).select(
        F.lit(2).alias("chart_order"), F.lit("Bar Chart").alias("chart_type"),
        F.lit("Top Rankings by Country").alias("title"),
        F.row_number().over(Window.orderBy(F.desc("value"), "name")).alias("position"),
        F.col("name").alias("label"), "value")
    return line.unionByName(pie).unionByName(bar)


def _chart_digest_sql() -> str:
    a3, a4, a5 = (ORACLE["a3_daily_series"], ORACLE["a4_category_share"], ORACLE["a5_country_ranking"])
    return f"""WITH pts AS (
  SELECT 0 AS chart_order, 'Line Chart' AS chart_type, 'Net Amount Over Time' AS title,
         row_number() OVER (ORDER BY date) AS position, date AS label, value FROM ({a3})
  UNION ALL SELECT 1, 'Pie Chart', 'Net Amount Split by Category Name',
         row_number() OVER (ORDER BY value DESC, name), name, value FROM ({a4})
  UNION ALL SELECT 2, 'Bar Chart', 'Top Rankings by Country',
         row_number() OVER (ORDER BY value DESC, name), name, value FROM ({a5}))
SELECT chart_order, '- ' || chart_type || ' ''' || title || ''': Top values -> ' ||
       string_agg(label || ': ' || {exprs.float_text_sql('value')}, ', ' ORDER BY position) AS line
FROM pts WHERE position <= 5 GROUP BY chart_order, chart_type, title"""


@register("t11_chart_digest", _chart_digest_sql())
def t11_chart_digest(spark, sf_dir):
    return digest_ops.chart_digest(_chart_points(spark, sf_dir))


def _context_document(spark, sf_dir):
    t = Tables(spark, sf_dir, wide=True)
    flat = stage(sales_lines(t), "sales-lines")  # read by several passes below
    prof = prof_ops.profile(flat)
    dom = prof_ops.classify_domain(prof)
    records = flat.agg(F.count(F.lit(1)).alias("n"))
    kpis = dash.evaluate_kpis(flat, prof_ops.suggest_kpis(prof))
    skew_cols = [r["column_name"] for r in prof.where(F.col("data_type").isin("Integer", "Float")
                                                      & F.col("mean_value").isNotNull())
                 .orderBy("ordinal").select("column_name").collect()]  # one row per column
    skew = dash.skewness_insights(flat, skew_cols).where(F.col("insight").isNotNull())
    ins = prof_ops.ingest_insights(prof, dom, records).unionByName(
        skew.select((F.lit(100) + F.monotonically_increasing_id()).cast("int").alias("insight_order"),
                    F.col("insight").alias("text")))
    # forecast and segments of the described lines, as the document says
    rows, accuracy = fc.forecast(flat, "order_date", "net_amount", 30)
    fdig = prof_ops.one_row(fc.digest(rows), accuracy.select("mape"))
    segs = seg_ops.segment_summary(seg_ops.segment_customers(flat, "customer_id", "net_amount", "order_date"))
    return digest_ops.context_document("sales_lines", dom, records, digest_ops.column_digest(prof), kpis,
                                       digest_ops.chart_digest(_chart_points(spark, sf_dir)), ins, fdig, segs, "net_amount")


@register("t12_context_document")
def t12_context_document(spark, sf_dir):
    return _context_document(spark, sf_dir)


@register("t9_context_sections")
def t9_context_sections(spark, sf_dir):
    return conv_ops.sections(_context_document(spark, sf_dir).withColumn("doc_id", F.lit(0)))


_SECTIONED = "'=== ' || source || ' ===' || chr(10) || text || chr(10) || '=== ' || lang || chr(10) || doc_id"


@register("t9_document_sections", f"""
WITH l AS (SELECT doc_id, unnest(string_split({_SECTIONED}, chr(10))) AS line,
                  generate_subscripts(string_split({_SECTIONED}, chr(10)), 1) - 1 AS line_no FROM documents),
s AS (SELECT *, last_value(CASE WHEN starts_with(line, '===') THEN line END IGNORE NULLS)
             OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM l)
SELECT doc_id, section, CAST(line_no AS INTEGER) AS line_no, line FROM s
WHERE section IS NOT NULL AND NOT starts_with(line, '===') AND length(trim(line)) > 0""")
def t9_document_sections(spark, sf_dir):
    """Lines by section of every document: its source's section holds the text."""
    nl = F.lit("\n")
    doc = F.concat(F.lit("=== "), F.col("source"), F.lit(" ==="), nl, F.col("text"), nl, F.lit("=== "), F.col("lang"), nl,
                   F.col("doc_id").cast("string"))
    out = conv_ops.sections(Tables(spark, sf_dir).documents.select("doc_id", doc.alias("document")))
    return out.select("doc_id", "section", "line_no", "line")


# ---------------------------------------------------------------- data quality
from .operators import quality as q_ops  # noqa: E402


def _check_specs():
    return [
        ("lineitem", {"quantity > 0": F.col("l_quantity") > 0,
                      "unit_price >= 0": F.col("l_extendedprice") >= 0,
                      "net_amount >= 0": F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")) >= 0,
                      "discount between 0 and 1": F.col("l_discount").between(0, 1)}),
        ("orders", {"total_amount >= 0": F.col("o_totalprice") >= 0}),
        ("part", {"list_price >= 0": F.col("p_retailprice") >= 0}),
    ]


_CHECK_SQL = [
    ("lineitem", [("quantity > 0", "l_quantity > 0"), ("unit_price >= 0", "l_extendedprice >= 0"),
                  ("net_amount >= 0", "l_extendedprice * (1.0 - l_discount) >= 0"),
                  ("discount between 0 and 1", "l_discount BETWEEN 0 AND 1")]),
    ("orders", [("total_amount >= 0", "o_totalprice >= 0")]),
    ("part", [("list_price >= 0", "p_retailprice >= 0")]),
]


@register("q1_check_rules", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{n}' AS rule, count(*) AS checked, count_if(NOT coalesce({c}, true)) AS violations FROM {t}"
    for t, rs in _CHECK_SQL for n, c in rs))
def q1_check_rules(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = None
    for table, checks in _check_specs():
        r = q_ops.check_rules(getattr(t, table), table, checks)
        out = r if out is None else out.unionByName(r)
    return out


_UNIQUE = [("customer", ["c_custkey"]), ("customer", ["c_name"]), ("supplier", ["s_suppkey"]),
           ("part", ["p_partkey"]), ("orders", ["o_orderkey"]), ("lineitem", ["l_orderkey", "l_linenumber"])]


@register("q2_uniqueness", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{','.join(k)}' AS key, count(*) AS duplicate_keys, "
    f"CAST(coalesce(sum(c), 0) AS BIGINT) AS duplicate_rows "
    f"FROM (SELECT count(*) AS c FROM {t} GROUP BY {', '.join(k)} HAVING count(*) > 1)" for t, k in _UNIQUE))
def q2_uniqueness(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = None
    for table, key in _UNIQUE:
        r = q_ops.uniqueness_report(getattr(t, table), table, key)
        out = r if out is None else out.unionByName(r)
    return out


_NOT_NULL = [("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]),
             ("orders", ["o_orderkey", "o_custkey", "o_orderdate"]), ("customer", ["c_custkey", "c_name"])]


@register("q3_not_null", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS checked, count_if({c} IS NULL) AS nulls FROM {t}"
    for t, cs in _NOT_NULL for c in cs))
def q3_not_null(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = None
    for table, cols in _NOT_NULL:
        r = q_ops.not_null_report(getattr(t, table), table, cols)
        out = r if out is None else out.unionByName(r)
    return out


_FKS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"),
        ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
        ("nation", "n_regionkey", "region", "r_regionkey")]


@register("q4_orphans", " UNION ALL ".join(
    f"SELECT '{ct}' AS child_table, '{fk}' AS fk, '{pt}' AS parent_table, '{pk}' AS pk, count(*) AS orphan_keys, "
    f"CAST(coalesce(sum(c), 0) AS BIGINT) AS orphan_rows FROM (SELECT {fk} AS k, count(*) AS c FROM {ct} "
    f"WHERE {fk} IS NOT NULL GROUP BY {fk}) x WHERE NOT EXISTS (SELECT 1 FROM {pt} WHERE {pt}.{pk} = x.k)"
    for ct, fk, pt, pk in _FKS))
def q4_orphans(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = None
    for ct, fk, pt, pk in _FKS:
        r = q_ops.orphan_report(getattr(t, ct), ct, fk, getattr(t, pt), pt, pk)
        out = r if out is None else out.unionByName(r)
    return out


# ---------------------------------------------------------------- declared metrics
from .operators import metrics as m_ops  # noqa: E402

_D1_COLS = ["order_number", "customer_id", "net_amount", "gross_amount", "quantity"]


@register("d1_sales_kpis", f"""
SELECT round(sum(net_amount), 2) AS revenue, round(sum(gross_amount), 2) AS gross_sales,
       round(sum(gross_amount) - sum(net_amount), 2) AS discounts, count(DISTINCT order_number) AS orders,
       count(DISTINCT customer_id) AS customers, round(sum(quantity), 2) AS items,
       round(sum(net_amount) / count(DISTINCT order_number), 2) AS aov
FROM {sales_lines_sql(_D1_COLS)} f""")
def d1_sales_kpis(spark, sf_dir):
    flat = sales_lines(Tables(spark, sf_dir), _D1_COLS)
    k = m_ops.sales_kpis(flat, "order_number", "customer_id", "net_amount", "gross_amount", "quantity")
    return k.select(*[r2(c).alias(c) if c not in ("orders", "customers") else F.col(c) for c in k.columns])


# The tables carry no cost.  Stated here: a unit costs this share of its part's list price.
COST_SHARE = 0.6
_PROFIT_COLS = [*_D1_COLS, "list_price"]


@register("d1_profit_margin", f"""
SELECT round(sum(net_amount), 2) AS revenue, round(sum(gross_amount), 2) AS gross_sales,
       round(sum(gross_amount) - sum(net_amount), 2) AS discounts, count(DISTINCT order_number) AS orders,
       count(DISTINCT customer_id) AS customers, round(sum(quantity), 2) AS items,
       round(sum(net_amount) / count(DISTINCT order_number), 2) AS aov,
       round(sum(net_amount) - sum(quantity * list_price * {COST_SHARE}), 2) AS profit,
       round((sum(net_amount) - sum(quantity * list_price * {COST_SHARE})) * 100.0 / sum(net_amount), 6) AS margin_pct
FROM {sales_lines_sql(_PROFIT_COLS)} f""")
def d1_profit_margin(spark, sf_dir):
    """D1 with profit and margin, at the stated cost."""
    flat = sales_lines(Tables(spark, sf_dir), _PROFIT_COLS).withColumn("cost", F.col("quantity") * F.col("list_price") * F.lit(COST_SHARE))
    k = m_ops.sales_kpis(flat, "order_number", "customer_id", "net_amount", "gross_amount", "quantity", "cost")
    return k.select(*[F.col(c) if c in ("orders", "customers") else (r6 if c == "margin_pct" else r2)(c).alias(c) for c in k.columns])


@register("d2_monthly_growth", f"""
WITH m AS (SELECT date_trunc('month', order_date) AS mo, sum(net_amount) AS value
           FROM {sales_lines_sql(["order_date", "net_amount"])} f GROUP BY 1)
SELECT strftime(mo, '%Y-%m') AS month, round(value, 2) AS value,
       round(CASE WHEN lag(value) OVER (ORDER BY mo) <> 0
             THEN (value - lag(value) OVER (ORDER BY mo)) / lag(value) OVER (ORDER BY mo) * 100.0 END, 6) AS growth_pct
FROM m""")
def d2_monthly_growth(spark, sf_dir):
    flat = sales_lines(Tables(spark, sf_dir), ["order_date", "net_amount"])
    g = m_ops.monthly_growth(flat, "order_date", "net_amount")
    return g.select("month", r2("value").alias("value"), r6("growth_pct").alias("growth_pct"))


@register("d3_return_rate", """
SELECT count(*) AS lines, count_if(l_returnflag = 'R') AS returned,
       round(count_if(l_returnflag = 'R') * 100.0 / count(*), 6) AS return_rate_pct FROM lineitem""")
def d3_return_rate(spark, sf_dir):
    r = m_ops.return_rate(Tables(spark, sf_dir).lineitem, F.col("l_returnflag") == "R")
    return r.withColumn("return_rate_pct", r6("return_rate_pct"))


@register("d5_repeat_purchase_rate", """
WITH per AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY o_custkey)
SELECT count(*) AS customers, count_if(n > 1) AS repeat_customers,
       round(count_if(n > 1) * 100.0 / count(*), 6) AS repeat_rate_pct FROM per""")
def d5_repeat_purchase_rate(spark, sf_dir):
    r = m_ops.repeat_purchase_rate(Tables(spark, sf_dir).orders, "o_custkey", "o_orderkey")
    return r.withColumn("repeat_rate_pct", r6("repeat_rate_pct"))


@register("d6_supplier_performance", f"""
SELECT supplier_name AS name, CAST(round(sum(CAST(net_amount AS DECIMAL(38,4))), 2) AS DOUBLE) AS value
FROM {sales_lines_sql(["supplier_name", "net_amount"])} f
GROUP BY supplier_name ORDER BY sum(net_amount) DESC, name LIMIT 10""")
def d6_supplier_performance(spark, sf_dir):
    sums = rollup.sum_by(Tables(spark, sf_dir), "supplier_name", "net_amount")
    return dash.top_share(sums, "supplier_name", "value", rules.BAR_TOP).withColumn(
        "value", r2("value").cast("double"))


@register("d6_category_split", f"""
SELECT category_name AS name, CAST(round(sum(CAST(net_amount AS DECIMAL(38,4))), 2) AS DOUBLE) AS value,
       round(sum(net_amount) * 100.0 / sum(sum(net_amount)) OVER (), 6) AS share_pct
FROM {sales_lines_sql(["category_name", "net_amount"])} f GROUP BY category_name""")
def d6_category_split(spark, sf_dir):
    sums = rollup.sum_by(Tables(spark, sf_dir), "category_name", "net_amount")
    g = sums.groupBy(F.col("category_name").alias("name")).agg(F.sum("value").alias("v"))
    tot = g.agg(F.sum("v").alias("t")).first()["t"]  # one scalar
    return g.select("name", r2("v").cast("double").alias("value"),
                    r6(F.col("v").cast("double") * 100.0 / F.lit(float(tot))).alias("share_pct"))


_KEY_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
_KEY_COLUMNS = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"],
                "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"],
                "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"],
                "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"]}


def _key_candidates():
    """Column pairs with the same key name after the table prefix."""
    out = []
    for ct in _KEY_TABLES:
        for cc in _KEY_COLUMNS[ct]:
            for pt in _KEY_TABLES:
                if pt == ct:
                    continue
                for pc in _KEY_COLUMNS[pt]:
                    if cc.split("_", 1)[1] == pc.split("_", 1)[1]:
                        out.append((ct, cc, pt, pc))
    return out


def _key_sql() -> str:
    parts = []
    for ct, cc, pt, pc in _key_candidates():
        parts.append(f"""SELECT '{ct}' AS child_table, '{cc}' AS child_column, '{pt}' AS parent_table, '{pc}' AS parent_column,
  (SELECT count(DISTINCT {cc}) FROM {ct}) AS child_values,
  (SELECT count(*) FROM (SELECT DISTINCT {cc} AS v FROM {ct} WHERE {cc} IS NOT NULL) x
     WHERE EXISTS (SELECT 1 FROM {pt} WHERE {pt}.{pc} = x.v)) AS matched_values,
  (SELECT coalesce(max(c) <= 1, true) FROM (SELECT count(*) AS c FROM {pt} WHERE {pc} IS NOT NULL GROUP BY {pc})) AS parent_unique""")
    return f"""SELECT child_table, child_column, parent_table, parent_column, child_values, matched_values,
  round(CAST(matched_values AS DOUBLE) / child_values, 6) AS containment, parent_unique,
  CASE WHEN parent_unique THEN 'many-to-one' ELSE 'many-to-many' END AS cardinality,
  round(CAST(matched_values AS DOUBLE) / child_values * 100.0, 2) AS confidence
FROM ({' UNION ALL '.join(parts)})"""


@register("d7_key_relationships", _key_sql())
def d7_key_relationships(spark, sf_dir):
    t = Tables(spark, sf_dir)
    cands = [(ct, getattr(t, ct), cc, pt, getattr(t, pt), pc) for ct, cc, pt, pc in _key_candidates()]
    out = m_ops.key_relationships(cands)
    return out.withColumn("containment", r6("containment"))


_DISCOVERY = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_regionkey", "n_name"],
              "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "supplier": ["s_suppkey", "s_name", "s_nationkey"],
              "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
              "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
              "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]}
_DISCOVERY_TEXT = {"r_name", "n_name", "c_name", "c_mktsegment", "s_name", "p_name", "p_brand", "p_type", "o_orderstatus",
                   "o_orderpriority", "l_returnflag", "l_linestatus"}


def _discovery_sql() -> str:
    """Every pair of columns of a family, by brute force."""
    cols = [(t, c) for t, cs in _DISCOVERY.items() for c in cs]
    vals = ", ".join(f"v_{c} AS (SELECT CAST({c} AS {'VARCHAR' if c in _DISCOVERY_TEXT else 'BIGINT'}) AS v, count(*) AS n "
                     f"FROM {t} WHERE {c} IS NOT NULL GROUP BY 1)" for t, c in cols)
    pairs = " UNION ALL ".join(
        f"SELECT '{ct}' AS child_table, '{cc}' AS child_column, '{pt}' AS parent_table, '{pc}' AS parent_column, "
        f"(SELECT count(*) FROM v_{cc}) AS child_values, (SELECT count(*) FROM v_{cc} a JOIN v_{pc} b USING (v)) AS matched_values, "
        f"(SELECT max(n) = 1 FROM v_{pc}) AS parent_unique, (SELECT count(*) FROM v_{pc}) AS parent_values"
        for ct, cc in cols for pt, pc in cols if ct != pt and (cc in _DISCOVERY_TEXT) == (pc in _DISCOVERY_TEXT))
    return f"""WITH {vals}, p AS ({pairs})
SELECT child_table, child_column, parent_table, parent_column, child_values, matched_values,
  round(CAST(matched_values AS DOUBLE) / child_values, 6) AS containment, parent_unique, 'many-to-one' AS cardinality,
  round(CAST(matched_values AS DOUBLE) / child_values * 100.0, 2) AS confidence,
  round(CAST(matched_values AS DOUBLE) / parent_values, 6) AS coverage
FROM p WHERE parent_unique AND child_values > 0 AND matched_values >= 0.95 * child_values"""


@register("d7_discovered_relationships", _discovery_sql())
def d7_discovered_relationships(spark, sf_dir):
    """Keys and the columns that refer to them, found by their values alone."""
    t = Tables(spark, sf_dir)
    out = m_ops.discover_relationships({name: getattr(t, name).select(*cols) for name, cols in _DISCOVERY.items()})
    return out.withColumn("containment", r6("containment")).withColumn("coverage", r6("coverage"))


# ---------------------------------------------------------------- sources and reports
import uuid as _uuid  # noqa: E402

from .operators import reports as rep_ops  # noqa: E402
from .sources import catalog as cat_ops  # noqa: E402
from .sources import upload as up_ops  # noqa: E402


@register("s2_parquet_scan", "SELECT * FROM lineitem")
def s2_parquet_scan(spark, sf_dir):
    return Tables(spark, sf_dir).lineitem


def _customer_csv(spark, sf_dir) -> str:
    """Render the customer table as a CSV upload in the shared folder."""
    path = shared_dir(spark, f"uploads/customer-{_uuid.uuid4().hex}.csv")
    Tables(spark, sf_dir).customer.write.option("header", True).csv(path)
    return path


@register("s1_csv_upload", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
       CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer""")
def s1_csv_upload(spark, sf_dir):
    return up_ops.read_upload_csv(spark, _customer_csv(spark, sf_dir))


_NA_SQL = ", ".join(twins.q(t) for t in rules.CSV_NA_TOKENS)


@register("s1_csv_line_breaks", " UNION ALL ".join(
    f"SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, "
    f"CASE WHEN {t} NOT IN ({_NA_SQL}) THEN {t} END AS text FROM conversations" for t in ("text",)))
def s1_csv_line_breaks(spark, sf_dir):
    """Conversations as a CSV upload: texts with line breaks, commas and quotes, read split by split."""
    path = shared_dir(spark, f"uploads/conversations-{_uuid.uuid4().hex}.csv")
    Tables(spark, sf_dir).conversations.write.options(
        header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="").csv(path)
    return up_ops.read_upload_csv(spark, path)


_CUST_CLEAN = ("(SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name, CAST(c_nationkey AS DOUBLE) AS c_nationkey, "
               f"{exprs.np_round_sql('c_acctbal', 4)} AS c_acctbal, c_mktsegment FROM customer) cc")


@register("e1_csv_ingest_profile", _round_stats_sql(twins.profile_sql(
    _CUST_CLEAN, [("c_custkey", "Float"), ("c_name", "Text"), ("c_nationkey", "Float"), ("c_acctbal", "Float"),
                  ("c_mktsegment", "Text")])))
def e1_csv_ingest_profile(spark, sf_dir):
    """Upload end to end: CSV text -> clean -> profile."""
    up = up_ops.check_upload(spark, "customer.csv", _customer_csv(spark, sf_dir))
    return _round_stats(prof_ops.profile(clean_ops.clean(up).data, materialize=True))


@register("s8_report_sample", f"""
SELECT * FROM {sales_lines_sql(SEARCH_COLS)} f ORDER BY ALL LIMIT {rules.REPORT_SAMPLE_ROWS}""")
def s8_report_sample(spark, sf_dir):
    flat = sales_lines(Tables(spark, sf_dir), SEARCH_COLS)
    return rep_ops.report_sample(flat, SEARCH_COLS)


def _cut_sql(c: str) -> str:
    k = rules.REPORT_CELL_CHARS
    return (f"CASE WHEN {c} IS NULL OR {c} = '' THEN 'N/A' WHEN length({c}) > {k} "
            f"THEN substr({c}, 1, {k}) || '..' ELSE {c} END")


def _na_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'N/A' ELSE CAST(round({c}, 6) AS VARCHAR) END"


@register("s9_report_profile_section", f"""WITH prof AS ({_flat_profile_sql()})
SELECT ordinal, column_name, data_type, semantic_type, null_percentage, distinct_count,
  {_cut_sql('min_value')} AS min_value, {_cut_sql('max_value')} AS max_value,
  {_na_sql('mean_value')} AS mean_value, {_na_sql('median_value')} AS median_value,
  {_na_sql('std_dev_value')} AS std_dev_value FROM prof""")
def s9_report_profile_section(spark, sf_dir):
    return rep_ops.profile_section(_round_stats(_flat_profile(spark, sf_dir)))


@register("s9_report_header", f"""WITH d AS ({ORACLE['p8_domain']}), n AS (SELECT count(*) AS n FROM {sales_lines_sql(FLAT_COLUMNS)} f),
k AS (SELECT count(*) AS kpi_count FROM ({ORACLE['p9_kpi_suggestions']})),
i AS (SELECT count(*) AS insight_count FROM ({ORACLE['p12_p13_ingest_insights']}))
SELECT domain, confidence_score, format('{{:,}}', n) AS record_count, kpi_count, insight_count FROM d, n, k, i""")
def s9_report_header(spark, sf_dir):
    """The header of a report, from the metadata stored with the dataset."""
    root = shared_dir(spark, f"catalog-{_uuid.uuid4().hex}")
    flat = stage(sales_lines(Tables(spark, sf_dir, wide=True)), "sales-lines")
    prof = prof_ops.profile(flat)
    records = flat.agg(F.count(F.lit(1)).alias("n"))
    cat_ops.store_metadata(root, "sales", prof, prof_ops.suggest_kpis(prof),
                           prof_ops.ingest_insights(prof, prof_ops.classify_domain(prof), records))
    stored = lambda table: cat_ops.stored_metadata(spark, root, table, "sales")
    return rep_ops.header_section(prof_ops.classify_domain(stored("column_metadata")), records,
                                  stored("generated_kpis"), stored("generated_insights"))


# ---------------------------------------------------------------- dashboard assembly
def _a7_sql() -> str:
    o = ORACLE
    names = ", ".join(f"({i}, {twins.q(c)})" for i, c in enumerate(FLAT_COLUMNS))
    return f"""
WITH prof AS (SELECT * FROM (VALUES {names}) v(ordinal, column_name)), dom AS ({twins.domain_sql('prof')})
SELECT 'header' AS section, 1 AS position, 'filename' AS label, 'sales_lines' AS value
UNION ALL SELECT 'header', 2, 'domain', domain FROM dom
UNION ALL SELECT 'header', 3, 'confidence_score', {exprs.float_text_sql('confidence_score')} FROM dom
UNION ALL SELECT 'header', 4, 'record_count', CAST(count(*) AS VARCHAR) FROM {sales_lines_sql(["order_number"])} f
UNION ALL SELECT 'kpi' AS section, CAST(kpi_order AS INTEGER) AS position, kpi_name AS label, value FROM ({o['a1_kpi_values']})
UNION ALL SELECT 'line', CAST(row_number() OVER (ORDER BY date) AS INTEGER), date, {exprs.float_text_sql('value')}
  FROM ({o['a3_daily_series']})
UNION ALL SELECT 'pie', CAST(row_number() OVER (ORDER BY value DESC, name) AS INTEGER), name,
  {exprs.float_text_sql('value')} FROM ({o['a4_category_share']})
UNION ALL SELECT 'bar', CAST(row_number() OVER (ORDER BY value DESC, name) AS INTEGER), name,
  {exprs.float_text_sql('value')} FROM ({o['a5_country_ranking']})
UNION ALL SELECT 'insight', CAST(row_number() OVER (ORDER BY column_name) AS INTEGER), column_name, insight
  FROM ({o['a6_skewness_insights']}) WHERE insight IS NOT NULL"""


# the KPIs as formulas over the one-row sums of all lines
_A7_KPIS = [("Total Net Amount", "SUM(net_amount)", "net_amount"), ("Total Unit Price", "SUM(unit_price)", "unit_price"),
            ("Total Quantity", "SUM(quantity)", "quantity"), ("Total Records Volume", "COUNT(customer_id)", "customers")]


@register("a7_dashboard_document", _a7_sql())
def a7_dashboard_document(spark, sf_dir):
    """The whole dashboard from one scan of the lines."""
    t = Tables(spark, sf_dir)
    parts = rollup.dashboard_parts(t, rollup.dashboard_sums(t, SKEW_COLS), SKEW_COLS)
    kpis = dash.show_kpis(parts["kpis"], _A7_KPIS)
    cents = lambda df: df.withColumn("value", r2("value").cast("double"))
    head = dash.dashboard_header("sales_lines", p8_domain(spark, sf_dir), parts["records"])
    return dash.dashboard_document(
        kpis, cents(dash.daily_series(parts["series"], "order_date", "value")),
        cents(dash.top_share(parts["category"], "category_name", "value", rules.PIE_TOP)),
        cents(dash.top_share(parts["country"], "country", "value", rules.BAR_TOP)), dash.skewness_text(parts["skewness"]), head)


# ---------------------------------------------------------------- storage, catalog, inventory

def _orders_catalog(spark, sf_dir):
    """Orders read as catalog rows: an order is a dataset, its customer the owner."""
    return Tables(spark, sf_dir).orders.select(
        F.col("o_orderkey").cast("string").alias("dataset_id"), F.col("o_custkey").cast("string").alias("uploaded_by"),
        F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("record_count"))


@register("s6_dataset_listing", """
SELECT CAST(o_custkey AS VARCHAR) AS owner, CAST(o_orderkey AS VARCHAR) AS dataset_id, strftime(o_orderdate, '%Y-%m-%d') AS created,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR)) AS position
FROM orders""")
def s6_dataset_listing(spark, sf_dir):
    lists = cat_ops.dataset_lists(_orders_catalog(spark, sf_dir))
    return lists.select(F.col("uploaded_by").alias("owner"), "dataset_id",
                        F.date_format("created_at", "yyyy-MM-dd").alias("created"), "position")


@register("s7_resolve_dataset", """
WITH c AS (SELECT CAST(o_orderkey AS VARCHAR) AS dataset_id, o_custkey AS owner, o_orderdate AS created FROM orders),
latest AS (SELECT owner, dataset_id AS latest FROM (SELECT *, row_number() OVER (PARTITION BY owner
           ORDER BY created DESC, dataset_id DESC) AS k FROM c) WHERE k = 1),
req AS (SELECT c_custkey AS owner, CAST(c_custkey * 3 AS VARCHAR) AS requested_id FROM customer)
SELECT CAST(req.owner AS VARCHAR) AS owner, requested_id,
       CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.owner = req.owner AND c.dataset_id = req.requested_id)
            THEN requested_id ELSE latest END AS resolved_id
FROM req LEFT JOIN latest ON latest.owner = req.owner""")
def s7_resolve_dataset(spark, sf_dir):
    asked = Tables(spark, sf_dir).customer.select(F.col("c_custkey").cast("string").alias("owner"),
                                                  (F.col("c_custkey") * 3).cast("string").alias("dataset_id"))
    return cat_ops.resolve_datasets(_orders_catalog(spark, sf_dir), asked)


_ORDER_COLS = ["o_orderkey", "o_custkey", "o_totalprice"]


@register("s3_d8_dataset_versions", """
SELECT 'raw' AS version, o_orderkey, o_custkey, o_totalprice FROM orders
UNION ALL SELECT 'cleaned', o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 0""")
def s3_d8_dataset_versions(spark, sf_dir):
    """Two versions of one dataset, published and read back."""
    root = shared_dir(spark, f"catalog-{_uuid.uuid4().hex}")
    orders = Tables(spark, sf_dir).orders.select(*_ORDER_COLS)
    out = None
    for version, df in (("raw", orders), ("cleaned", orders.where("o_totalprice > 0"))):
        cat_ops.write_dataset(df, root, "orders", version)
        back = cat_ops.read_dataset(spark, root, "orders", version).select(F.lit(version).alias("version"), *_ORDER_COLS)
        out = back if out is None else out.unionByName(back)
    return out


@register("s3_s5_publish_rollback", """
SELECT 'after the failed publish' AS state, 1 AS listed, o_orderkey, o_custkey, o_totalprice FROM orders
UNION ALL SELECT 'after the next publish', 1, o_orderkey, o_custkey, o_totalprice * 2 FROM orders""")
def s3_s5_publish_rollback(spark, sf_dir):
    """A publish whose catalog rows fail leaves the dataset as it was; the next
    one replaces it.  ``listed``: catalog rows of the dataset then visible."""
    root = shared_dir(spark, f"catalog-{_uuid.uuid4().hex}")
    orders = Tables(spark, sf_dir).orders.select(*_ORDER_COLS)
    doubled = orders.withColumn("o_totalprice", F.col("o_totalprice") * 2)
    fails = orders.limit(1).select(F.lit(0).alias("insight_order"), F.raise_error(F.lit("no insight")).cast("string").alias("text"))

    def put(df, **kw):
        cat_ops.publish(df, root, "orders", "orders.csv", "owner", "Retail", 40.0, df.count(), **kw)

    def state(name):
        listed = cat_ops.read_catalog(spark, root, "datasets").count()
        return cat_ops.read_dataset(spark, root, "orders").select(F.lit(name).alias("state"), F.lit(listed).alias("listed"), *_ORDER_COLS)

    put(orders)
    try:
        put(doubled, metadata={"generated_insights": fails})
    except Exception as e:  # the job's own error, and no other
        if "no insight" not in str(e):
            raise
    kept = state("after the failed publish")
    put(doubled)
    return kept.unionByName(state("after the next publish"))


_CHANGED_SQL = """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 10 > 1
UNION ALL SELECT o_orderkey, o_custkey, o_totalprice + 1 FROM orders WHERE o_orderkey % 10 = 1
UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 10 = 7
UNION ALL SELECT -o_orderkey - 1, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 10 = 5"""


@register("d8_version_difference", f"""
WITH n AS ({_CHANGED_SQL}),
net AS (SELECT o_orderkey, o_custkey, o_totalprice, sum(s) AS net FROM (
          SELECT o_orderkey, o_custkey, o_totalprice, -1 AS s FROM orders
          UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, 1 FROM n) GROUP BY ALL HAVING sum(s) <> 0),
b AS (SELECT *, min(net) OVER (PARTITION BY o_orderkey) < 0 AND max(net) OVER (PARTITION BY o_orderkey) > 0 AS both_sides FROM net)
SELECT o_orderkey, o_custkey, o_totalprice, CAST(abs(net) AS BIGINT) AS copies,
       CASE WHEN both_sides AND net > 0 THEN 'changed_to' WHEN both_sides THEN 'changed_from'
            WHEN net > 0 THEN 'added' ELSE 'removed' END AS change FROM b""")
def d8_version_difference(spark, sf_dir):
    """What a later version of the orders adds, removes, repeats and changes."""
    orders = Tables(spark, sf_dir).orders.select(*_ORDER_COLS)
    last = F.col("o_orderkey") % 10
    new = (orders.where(last > 1).unionByName(orders.where(last == 1).withColumn("o_totalprice", F.col("o_totalprice") + 1))
           .unionByName(orders.where(last == 7))
           .unionByName(orders.where(last == 5).withColumn("o_orderkey", -F.col("o_orderkey") - 1)))
    return cat_ops.version_difference(orders, new, ["o_orderkey"])


@register("d4_stock_out_rate", """
WITH inv AS (SELECT p_partkey, greatest(0, 800 - coalesce(CAST(sum(l_quantity) AS BIGINT), 0)) AS on_hand, 100 AS reorder_point
             FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey)
SELECT count(*) AS items, CAST(sum(on_hand) AS BIGINT) AS inventory_count, count_if(on_hand <= 0) AS stock_outs,
       count_if(on_hand <= reorder_point) AS below_reorder,
       round(count_if(on_hand <= 0) * 100.0 / count(*), 6) AS stock_out_rate_pct FROM inv""")
def d4_stock_out_rate(spark, sf_dir):
    """Inventory derived from the tables: 800 of each part less what was sold."""
    t = Tables(spark, sf_dir)
    sold = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").cast("long").alias("sold"))
    left = F.greatest(F.lit(0).cast("long"), F.lit(800).cast("long") - F.coalesce("sold", F.lit(0).cast("long")))
    inv = t.part.select("p_partkey").join(sold, "p_partkey", "left").select(
        left.alias("quantity_on_hand"), F.lit(100).alias("reorder_point"))
    return m_ops.stock_out_rate(inv).withColumn("stock_out_rate_pct", r6("stock_out_rate_pct"))
