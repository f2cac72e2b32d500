"""Sums over the star schema with the aggregation pushed below the joins.

``SUM(measure) GROUP BY <dimension attribute>`` over lineitem joined to its
dimensions is computed as: sum the line measure per foreign key first (a
partial aggregate per map task: a key holding a third of all lines is one
row per task before any shuffle), then join the -- much smaller -- per-key
sums to the dimension, then sum per attribute.  SUM is distributive, so the
result equals aggregating the joined rows; the big side never shuffles
whole and a hot key never makes a skewed join partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import exprs
from ..session import stage
from ..sources.tables import Tables
from . import star

# Money in cents and rates in hundredths are exact decimals: the product and
# the sums are then exact whatever order the partial sums are merged in (a
# double sum can land either side of a half cent and flip the rounding).
MONEY = "decimal(15,2)"

LINE_MEASURES = {
    "net_amount": lambda: (F.col("l_extendedprice").cast(MONEY)
                           * (F.lit(1).cast(MONEY) - F.col("l_discount").cast(MONEY))),
    "gross_amount": lambda: F.col("l_extendedprice"),
    "quantity": lambda: F.col("l_quantity"),
}


def _per_key(t: Tables, key: str, measure: str) -> DataFrame:
    return t.lineitem.groupBy(F.col(key).alias("_k")).agg(F.sum(LINE_MEASURES[measure]()).alias("_s"))


def sum_by(t: Tables, attr: str, measure: str = "net_amount") -> DataFrame:
    """(attr, value) partial sums of a line measure by a flat-view attribute.

    The rows are per-key partial sums; aggregate them once more by ``attr``
    (``dashboard.top_share`` / ``daily_series`` do) for the final totals.
    """
    g = star._GROUPS
    if attr in g["part"]:
        dim = t.part.select(F.col("p_partkey").alias("_k"), star._part()[attr].alias(attr))
        return _per_key(t, "l_partkey", measure).join(dim, "_k").select(attr, F.col("_s").alias("value"))
    if attr in g["supplier"]:
        dim = t.supplier.select(F.col("s_suppkey").alias("_k"), star._supplier()[attr].alias(attr))
        return _per_key(t, "l_suppkey", measure).join(dim, "_k").select(attr, F.col("_s").alias("value"))
    if attr in g["order"] or attr in g["customer"] or attr in g["geo"]:
        per_order = _per_key(t, "l_orderkey", measure)
        o = t.orders.select(F.col("o_orderkey").alias("_k"), "o_custkey", "o_orderdate")
        lines = per_order.join(o, "_k")
        if attr in g["order"]:
            return lines.select(star._order()[attr].alias(attr), F.col("_s").alias("value"))
        # one more push-down: sum per customer before the customer dimension
        per_cust = lines.groupBy(F.col("o_custkey").alias("_c")).agg(F.sum("_s").alias("_s"))
        cust = t.customer
        if attr in g["geo"]:
            cust = (cust.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
                        .join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")))
        expr: Column = (star._geo() if attr in g["geo"] else star._customer())[attr]
        dim = cust.select(F.col("c_custkey").alias("_c"), expr.alias(attr))
        return per_cust.join(dim, "_c").select(attr, F.col("_s").alias("value"))
    if attr in g["line"]:
        return t.lineitem.select(star._line()[attr].alias(attr), LINE_MEASURES[measure]().alias("value"))
    raise ValueError(f"unknown attribute {attr}")


# ---------------------------------------------------------------- all dashboard sums in one scan of the lines
def dashboard_sums(t: Tables, skew_cols: list[str]) -> DataFrame:
    """Everything the dashboard (A1, A3-A6) needs of the lines, from one scan.

    Grouping sets over the lines' keys, before any join: a row per order, a
    row per part and one for all lines (``level``: order, part, all).  A line
    stands in each of the three sets; what only the last one needs is null in
    the others, so their sums skip it.  The dimensions meet these sums, not
    the lines.  Written once: order keys and part keys are read apart.

    Columns: level, key, net (exact decimal), net_amount, unit_price,
    quantity (doubles), lines, and per skewness column its population
    skewness and count."""
    line = star._line()
    sets = F.array(F.struct(F.lit("order").alias("level"), F.col("l_orderkey").alias("key")),
                   F.struct(F.lit("part").alias("level"), F.col("l_partkey").alias("key")),
                   F.struct(F.lit("all").alias("level"), F.lit(None).cast("long").alias("key")))
    rows = t.lineitem.select(LINE_MEASURES["net_amount"]().alias("net"), line["net_amount"].alias("net_amount"),
                             line["unit_price"].alias("unit_price"), line["quantity"].alias("quantity"),
                             *[line[c].cast("double").alias(f"s{i}") for i, c in enumerate(skew_cols)],
                             F.explode(sets).alias("g"))
    rows = rows.select("g.level", "g.key", "net", "net_amount", "unit_price", "quantity",
                       *[F.when(F.col("g.level") == "all", F.col(f"s{i}")).alias(f"s{i}") for i in range(len(skew_cols))])
    per = rows.groupBy("level", "key").agg(
        F.sum("net").alias("net"), F.sum("net_amount").alias("net_amount"), F.sum("unit_price").alias("unit_price"),
        F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("lines"),
        *[a for i in range(len(skew_cols)) for a in (F.skewness(f"s{i}").alias(f"k{i}"), F.count(f"s{i}").alias(f"n{i}"))])
    return stage(per, "dashboard-sums")


def dashboard_parts(t: Tables, sums: DataFrame, skew_cols: list[str]) -> dict[str, DataFrame]:
    """The dashboard's inputs from :func:`dashboard_sums`:

    ``kpis`` (one row: net_amount, unit_price, quantity, customers: lines
    with an order that has one), ``series`` (order_date, value), ``category``
    (category_name, value), ``country`` (country, value): partial sums, and
    ``skewness`` (column_name, skewness) and ``records`` (n)."""
    orders = sums.where("level = 'order'").join(
        t.orders.select(F.col("o_orderkey").alias("key"), "o_custkey", "o_orderdate"), "key")
    kpis = orders.agg(F.sum("net_amount").alias("net_amount"), F.sum("unit_price").alias("unit_price"),
                      F.sum("quantity").alias("quantity"),
                      F.sum(F.when(F.col("o_custkey").isNotNull(), F.col("lines")).otherwise(0)).alias("customers"))
    customer = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(
        F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    spent = orders.groupBy("o_custkey").agg(F.sum("net").alias("value"))
    country = spent.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(star._geo()["country"].alias("country"), "value")
    parts = sums.where("level = 'part'").join(t.part.select(F.col("p_partkey").alias("key"), star._part()["category_name"].alias(
        "category_name")), "key").select("category_name", F.col("net").alias("value"))
    whole = sums.where("level = 'all'")
    skew = whole.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), exprs.corrected_skewness(F.col(f"k{i}"), F.col(f"n{i}").cast("double")).alias("skewness"))
        for i, c in enumerate(skew_cols)])))
    return {"kpis": kpis, "series": orders.select(star._order()["order_date"].alias("order_date"), F.col("net").alias("value")),
            "category": parts, "country": country, "skewness": skew, "records": whole.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("n"))}
