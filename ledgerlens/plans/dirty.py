"""A text 'upload' derived from the driver tables, with upload faults.

The reference cleans CSV uploads: text columns with currency signs,
thousands separators, missing values, junk, padded text, mixed date
formats and duplicated rows.  This view renders order lines (lineitem
joined with part) that way.  The faults are placed by fixed rules on the
line keys, so the same rows are faulty in the Spark view and its SQL twin;
every line of the table is kept (the duplicates are added on top).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.tables import Tables

UPLOAD_COLUMNS = ["order_number", "line_number", "product_code", "supplier_code", "ship_date",
                  "category_name", "quantity", "unit_price", "discount", "is_returned",
                  "line_status"]
# Row position of the upload (unique per line).
ORDER_KEY = ["order_number", "line_number", "product_code", "supplier_code"]


def upload_lines(t: Tables) -> DataFrame:
    li = t.lineitem
    p = t.part.select("p_partkey", "p_type", "p_retailprice")
    b = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    h = F.col("l_orderkey") + F.col("l_linenumber")
    ship = (F.when(h % 17 == 3, F.lit(None))
             .when(h % 7 == 1, F.date_format("l_shipdate", "MM/dd/yyyy"))
             .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")))
    cat = (F.when(h % 13 == 5, F.lit(None))
            .when(h % 19 == 7, F.lit("nan"))
            .when(h % 23 == 2, F.concat(F.lit("  "), F.col("p_type"), F.lit(" ")))
            .otherwise(F.col("p_type")))
    qty = F.when(h % 11 == 2, F.lit(None)).otherwise(F.col("l_quantity").cast("string"))
    price = (F.when(h % 29 == 4, F.lit("unknown"))
              .when(h % 10 == 0, F.concat(F.lit("$"), F.format_number("p_retailprice", 2)))
              .otherwise(F.col("p_retailprice").cast("string")))
    ret = (F.when(h % 31 == 6, F.lit(None))
            .when(F.col("l_returnflag") == "R", F.lit("Yes")).otherwise(F.lit("No")))
    # lines of every 50th order stand in the upload twice; read and joined once
    twice = F.col("l_orderkey") % 50 == 0
    b = b.withColumn("_copy", F.explode(F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return b.select(
        F.col("l_orderkey").cast("string").alias("order_number"),
        F.col("l_linenumber").cast("string").alias("line_number"),
        F.col("l_partkey").cast("string").alias("product_code"),
        F.col("l_suppkey").cast("string").alias("supplier_code"),
        ship.alias("ship_date"), cat.alias("category_name"), qty.alias("quantity"),
        price.alias("unit_price"), F.col("l_discount").cast("string").alias("discount"),
        ret.alias("is_returned"), F.col("l_linestatus").alias("line_status"))


def order_key_exprs():
    return [F.col(c).cast("long") for c in ORDER_KEY]


def upload_lines_sql() -> str:
    h = "(l.l_orderkey + l.l_linenumber)"
    return f"""(WITH b AS (SELECT
    CAST(l.l_orderkey AS VARCHAR) AS order_number, CAST(l.l_linenumber AS VARCHAR) AS line_number,
    CAST(l.l_partkey AS VARCHAR) AS product_code, CAST(l.l_suppkey AS VARCHAR) AS supplier_code,
    CASE WHEN {h} % 17 = 3 THEN NULL WHEN {h} % 7 = 1 THEN strftime(l.l_shipdate, '%m/%d/%Y')
         ELSE strftime(l.l_shipdate, '%Y-%m-%d') END AS ship_date,
    CASE WHEN {h} % 13 = 5 THEN NULL WHEN {h} % 19 = 7 THEN 'nan'
         WHEN {h} % 23 = 2 THEN '  ' || p.p_type || ' ' ELSE p.p_type END AS category_name,
    CASE WHEN {h} % 11 = 2 THEN NULL ELSE CAST(l.l_quantity AS VARCHAR) END AS quantity,
    CASE WHEN {h} % 29 = 4 THEN 'unknown' WHEN {h} % 10 = 0 THEN '$' || format('{{:,.2f}}', p.p_retailprice)
         ELSE CAST(p.p_retailprice AS VARCHAR) END AS unit_price,
    CAST(l.l_discount AS VARCHAR) AS discount,
    CASE WHEN {h} % 31 = 6 THEN NULL WHEN l.l_returnflag = 'R' THEN 'Yes' ELSE 'No' END AS is_returned,
    l.l_linestatus AS line_status
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)
  SELECT * FROM b UNION ALL SELECT * FROM b WHERE CAST(order_number AS BIGINT) % 50 = 0)"""
