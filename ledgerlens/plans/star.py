"""Star schema -> flat sales-line view.

The reference works on one flat upload per dataset (order lines with
customer, product, store and money columns).  On the driver's TPC-H-like
tables that flat view is lineitem joined with orders, customer (+ nation,
region), part and supplier.  Only the joins a caller's columns need are
planned: an inner join Catalyst cannot drop is never added for nothing.

Join strategy (what the plan does at scale):
* orders meet customer before the lines meet them, and the lines meet orders
  last: the lines are never dealt by customer, and cross the other joins
  without the orders' and customers' columns.
* lineitem - orders: both grow with the data; shuffled sort-merge join on
  the order key, AQE splits skewed partitions.
* customer / part / supplier: grow with the data as well, so no broadcast
  hint.  The planner broadcasts them only when its size estimate is below
  ``spark.sql.autoBroadcastJoinThreshold`` (a checked bound); AQE re-checks
  with runtime sizes.
* nation (25 rows) and region (5 rows) have a fixed size by the schema's
  definition and are broadcast explicitly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..sources.tables import Tables

# Flat columns in dataset order (the order matters: profile-driven picks
# take the first column of a semantic type).
FLAT_COLUMNS = [
    "order_number", "line_number", "order_date", "customer_id", "category_name",
    "product_name", "brand", "customer_name", "market_segment", "supplier_name",
    "country", "region", "quantity", "net_amount", "unit_price", "discount",
    "ship_date", "return_flag", "line_status",
]


def _line():
    return {
        "order_number": F.col("l_orderkey"),
        "line_number": F.col("l_linenumber"),
        "quantity": F.col("l_quantity"),
        "net_amount": F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")),
        "gross_amount": F.col("l_extendedprice"),
        "unit_price": F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")),
        "discount": F.col("l_discount"),
        "ship_date": F.col("l_shipdate"),
        "return_flag": F.col("l_returnflag"),
        "line_status": F.col("l_linestatus"),
    }


def _order():
    return {"order_date": F.col("o_orderdate"), "customer_id": F.col("o_custkey")}


def _customer():
    return {"customer_name": F.col("c_name"), "market_segment": F.col("c_mktsegment")}


def _geo():
    return {"country": F.col("n_name"), "region": F.col("r_name")}


def _part():
    return {"category_name": F.col("p_type"), "product_name": F.col("p_name"),
            "brand": F.col("p_brand"), "list_price": F.col("p_retailprice")}


def _supplier():
    return {"supplier_name": F.col("s_name")}


_GROUPS = {
    "line": ["order_number", "line_number", "quantity", "net_amount", "gross_amount", "unit_price", "discount",
             "ship_date", "return_flag", "line_status"],
    "order": ["order_date", "customer_id"],
    "customer": ["customer_name", "market_segment"],
    "geo": ["country", "region"],
    "part": ["category_name", "product_name", "brand", "list_price"],
    "supplier": ["supplier_name"],
}


def _exprs():
    return {**_line(), **_order(), **_customer(), **_geo(), **_part(), **_supplier()}


def own_column(t: Tables, name: str) -> DataFrame:
    """The values of a flat column in the table it comes from, unjoined."""
    group = "region" if name == "region" else next(g for g, names in _GROUPS.items() if name in names)
    table = {"line": "lineitem", "order": "orders", "geo": "nation"}.get(group, group)
    return getattr(t, table).select(_exprs()[name].alias(name))


def sales_lines(t: Tables, columns: list[str] | None = None,
                reading: Callable[[DataFrame, list[str]], DataFrame] | None = None) -> DataFrame:
    """Flat order-line view with only the joins ``columns`` need.

    ``reading(table, names)`` is applied to each table before any join: it gets
    the join keys and the table's flat columns ``names``, and returns the keys
    and what is to cross the joins in the columns' places (columns it leaves
    out are left out of the view; the joins stay)."""
    cols = list(FLAT_COLUMNS if columns is None else columns)
    expr = _exprs()
    unknown = [c for c in cols if c not in expr]
    if unknown:
        raise ValueError(f"unknown flat columns: {unknown}")
    need = set(cols)
    need_geo = bool(need & set(_GROUPS["geo"]))
    need_cust = need_geo or bool(need & set(_GROUPS["customer"]))
    need_orders = need_cust or bool(need & set(_GROUPS["order"]))
    need_part = bool(need & set(_GROUPS["part"]))
    need_supp = bool(need & set(_GROUPS["supplier"]))

    def own(table: DataFrame, keys: list[str], *groups: str) -> DataFrame:
        if reading is None:
            return table
        names = [c for c in cols if any(c in _GROUPS[g] for g in groups)]
        return reading(table.select(*keys, *[expr[c].alias(c) for c in names]), names)

    df = own(t.lineitem, ["l_orderkey", "l_partkey", "l_suppkey"], "line")
    if need_part:
        df = df.join(own(t.part, ["p_partkey"], "part"), F.col("l_partkey") == F.col("p_partkey"))
    if need_supp:
        df = df.join(own(t.supplier, ["s_suppkey"], "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    orders = own(t.orders, ["o_orderkey", "o_custkey"], "order") if need_orders else None
    if need_cust:
        cust = t.customer
        if need_geo:
            cust = (cust
                    .join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
                    .join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")))
        orders = orders.join(own(cust, ["c_custkey"], "customer", "geo"), F.col("o_custkey") == F.col("c_custkey"))
    if need_orders:
        df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if reading is not None:
        return df.select(*[c for c in cols if c in df.columns])
    return df.select(*[expr[c].alias(c) for c in cols])


# The same view in SQL (DuckDB dialect) for the oracle queries.
def sales_lines_sql(columns: list[str] | None = None) -> str:
    cols = list(FLAT_COLUMNS if columns is None else columns)
    sql_expr = {
        "order_number": "l.l_orderkey", "line_number": "l.l_linenumber",
        "quantity": "l.l_quantity",
        "net_amount": "l.l_extendedprice * (1.0 - l.l_discount)", "gross_amount": "l.l_extendedprice",
        "unit_price": "CASE WHEN l.l_quantity <> 0 THEN l.l_extendedprice / l.l_quantity END",
        "discount": "l.l_discount", "ship_date": "l.l_shipdate",
        "return_flag": "l.l_returnflag", "line_status": "l.l_linestatus",
        "order_date": "o.o_orderdate", "customer_id": "o.o_custkey",
        "customer_name": "c.c_name", "market_segment": "c.c_mktsegment",
        "country": "n.n_name", "region": "r.r_name",
        "category_name": "p.p_type", "product_name": "p.p_name", "brand": "p.p_brand",
        "list_price": "p.p_retailprice",
        "supplier_name": "s.s_name",
    }
    need = set(cols)
    need_geo = bool(need & set(_GROUPS["geo"]))
    need_cust = need_geo or bool(need & set(_GROUPS["customer"]))
    need_orders = need_cust or bool(need & set(_GROUPS["order"]))
    frm = "lineitem l"
    if need_orders:
        frm += " JOIN orders o ON l.l_orderkey = o.o_orderkey"
    if need_cust:
        frm += " JOIN customer c ON o.o_custkey = c.c_custkey"
    if need_geo:
        frm += (" JOIN nation n ON c.c_nationkey = n.n_nationkey"
                " JOIN region r ON n.n_regionkey = r.r_regionkey")
    if need & set(_GROUPS["part"]):
        frm += " JOIN part p ON l.l_partkey = p.p_partkey"
    if need & set(_GROUPS["supplier"]):
        frm += " JOIN supplier s ON l.l_suppkey = s.s_suppkey"
    sel = ", ".join(f"{sql_expr[c]} AS {c}" for c in cols)
    return f"(SELECT {sel} FROM {frm})"
