"""Business metrics declared by the reference's schema and plan.

The reference declares these fields (revenue, growth, return rate,
retention, trends, dataset relationships) without code; the definitions
below are ours and stated in each docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import exprs


def sales_kpis(lines: DataFrame, order_col: str, customer_col: str, revenue_col: str,
               gross_col: str, quantity_col: str, cost_col: str | None = None) -> DataFrame:
    """One aggregate over order lines.

    revenue = sum(revenue_col); gross = sum(gross_col); discounts = gross -
    revenue; orders / customers = distinct counts; aov = revenue / orders;
    items = sum(quantity).  With ``cost_col``: profit = revenue - cost and
    margin_pct = 100 * profit / revenue (the test tables carry no cost).
    """
    aggs = [F.sum(revenue_col).alias("revenue"), F.sum(gross_col).alias("gross_sales"),
            F.count_distinct(order_col).alias("orders"), F.count_distinct(customer_col).alias("customers"),
            F.sum(quantity_col).alias("items")]
    if cost_col:
        aggs.append(F.sum(cost_col).alias("_cost"))
    k = lines.agg(*aggs)
    out = k.select("revenue", "gross_sales", (F.col("gross_sales") - F.col("revenue")).alias("discounts"),
                   "orders", "customers", "items",
                   F.try_divide(F.col("revenue"), F.col("orders")).alias("aov"),
                   *([(F.col("revenue") - F.col("_cost")).alias("profit"),
                      F.try_divide((F.col("revenue") - F.col("_cost")) * 100.0, F.col("revenue")).alias("margin_pct")]
                     if cost_col else []))
    return out


def monthly_growth(lines: DataFrame, date_col: str, value_col: str) -> DataFrame:
    """D2 / D6 trend: value by calendar month and growth over the previous
    month in percent (null for the first month or a zero base).

    Output: month ('yyyy-MM'), value, growth_pct.
    """
    m = lines.groupBy(F.date_trunc("month", F.col(date_col)).alias("_m")).agg(F.sum(value_col).alias("value"))
    w = Window.orderBy("_m")  # one row per month: bounded by the calendar
    prev = F.lag("value").over(w)
    return m.select(F.date_format("_m", "yyyy-MM").alias("month"), "value",
                    F.when(prev != 0, (F.col("value") - prev) / prev * 100.0).alias("growth_pct"))


def return_rate(lines: DataFrame, flag: F.Column) -> DataFrame:
    """D3: share of lines returned, in percent.  Output: lines, returned, return_rate_pct."""
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(flag).alias("returned")).select(
        "lines", "returned", F.try_divide(F.col("returned") * 100.0, F.col("lines")).alias("return_rate_pct"))


def stock_out_rate(inventory: DataFrame, qty: str = "quantity_on_hand",
                   reorder: str = "reorder_point") -> DataFrame:
    """Inventory rows at zero stock and at/below the reorder point."""
    return inventory.agg(F.count(F.lit(1)).alias("items"), F.sum(qty).alias("inventory_count"),
                         F.count_if(F.col(qty) <= 0).alias("stock_outs"),
                         F.count_if(F.col(qty) <= F.col(reorder)).alias("below_reorder")).select(
        "items", "inventory_count", "stock_outs", "below_reorder",
        F.try_divide(F.col("stock_outs") * 100.0, F.col("items")).alias("stock_out_rate_pct"))


def repeat_purchase_rate(orders: DataFrame, customer_col: str, order_col: str) -> DataFrame:
    """Customers with more than one order over customers with any."""
    per = orders.groupBy(customer_col).agg(F.count_distinct(order_col).alias("_n"))
    return per.agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("_n") > 1).alias("repeat_customers")
                   ).select("customers", "repeat_customers",
                            F.try_divide(F.col("repeat_customers") * 100.0, F.col("customers")).alias("repeat_rate_pct"))


def _family(dt: T.DataType) -> str | None:
    """Columns of one family can hold the same keys."""
    if isinstance(dt, exprs.INTEGRAL_TYPES):
        return "integer"
    return "text" if isinstance(dt, T.StringType) else None


_FAMILY_TYPE = {"integer": "bigint", "text": "string"}


def _exact_figures(columns: dict[tuple[str, str], DataFrame], pairs: list[tuple[tuple, tuple]]):
    """Distinct values and most rows a value of every column, and the values
    both columns of a pair hold: ``({column: (distinct, most)}, {pair: shared})``.

    The values of all columns of a family are one stacked list, grouped once:
    a row a value with its count in every column (as many counters as
    columns), summed on the map side first."""
    stats, shared = {}, {}
    for family, kind in _FAMILY_TYPE.items():
        own = [k for k, df in columns.items() if _family(df.schema[k[1]].dataType) == family]
        if not own:
            continue
        at = {k: i for i, k in enumerate(own)}
        both = [p for p in pairs if p[0] in at and p[1] in at]
        stack = None
        for k, i in at.items():
            one = columns[k].where(F.col(k[1]).isNotNull()).select(F.col(k[1]).cast(kind).alias("v"), F.lit(i).alias("c"))
            stack = one if stack is None else stack.unionByName(one)
        held = stack.groupBy("v").agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in at.values()])
        row = held.agg(*[F.count_if(F.col(f"n{i}") > 0).alias(f"d{i}") for i in at.values()],
                       *[F.max(f"n{i}").alias(f"m{i}") for i in at.values()],
                       *[F.count_if((F.col(f"n{at[a]}") > 0) & (F.col(f"n{at[b]}") > 0)).alias(f"p{j}")
                         for j, (a, b) in enumerate(both)]).first()  # one row
        stats.update({k: (row[f"d{i}"], row[f"m{i}"] or 0) for k, i in at.items()})
        shared.update({p: row[f"p{j}"] for j, p in enumerate(both)})
    return stats, shared


RELATION = ("child_table string, child_column string, parent_table string, parent_column string, child_values long,"
            " matched_values long, _maxc long, parent_values long")


def _relations(spark, pairs, stats, shared) -> DataFrame:
    rows = [(*a, *b, stats.get(a, (0, 0))[0], shared.get((a, b), 0), stats.get(b, (0, 0))[1], stats.get(b, (0, 0))[0])
            for a, b in pairs]
    g = spark.createDataFrame(rows, RELATION)
    cont = F.try_divide(F.col("matched_values").cast("double"), F.col("child_values"))
    uniq = F.col("_maxc") <= 1
    return g.select("child_table", "child_column", "parent_table", "parent_column", "child_values",
                    "matched_values", cont.alias("containment"), uniq.alias("parent_unique"),
                    F.when(uniq, F.lit("many-to-one")).otherwise(F.lit("many-to-many")).alias("cardinality"),
                    F.round(cont * 100.0, 2).alias("confidence"), "parent_values")


def key_relationships(candidates: list[tuple[str, DataFrame, str, str, DataFrame, str]]) -> DataFrame:
    """For each candidate (child table, column) -> (parent table, column):
    how many distinct child values exist in the parent column, and whether
    the parent column is unique.

    Output: child_table, child_column, parent_table, parent_column,
    child_values, matched_values, containment, parent_unique, cardinality,
    confidence (= containment x 100, 2 dp).  Columns of different families
    (integer, text) share no values.
    """
    columns: dict[tuple[str, str], DataFrame] = {}
    for ct, cdf, cc, pt, pdf, pc in candidates:
        columns.setdefault((ct, cc), cdf)
        columns.setdefault((pt, pc), pdf)
    pairs = [((ct, cc), (pt, pc)) for ct, _, cc, pt, _, pc in candidates]
    stats, shared = _exact_figures(columns, pairs)
    return _relations(candidates[0][1].sparkSession, pairs, stats, shared).drop("parent_values")


# ---------------------------------------------------------------- relationship discovery (D7 without names)
SKETCH_VALUES = 1024   # hashes a column's sketch holds, about
SKETCH_EVIDENCE = 24   # hashes below both thresholds that a pair needs to be ruled out
SKETCH_SIGMAS = 6.0    # how far below the wanted containment a pair's sample must lie


def column_sketches(tables: dict[str, DataFrame], size: int = SKETCH_VALUES) -> dict[tuple[str, str], dict]:
    """A bottom-hash sketch of every integer and text column: the distinct
    hashes below a threshold that leaves about ``size`` of them.

    Hashes do not depend on the column, and sketches merge: the smaller
    threshold and the union of the hashes below it.  Two scans a table, each
    for all of its columns: counts, then the hashes that pass.

    Returns per (table, column): family, rows (not null), distinct (approximate),
    theta (share of the hash range below the threshold), hashes."""
    cols = {(t, f.name): (_family(f.dataType), df) for t, df in tables.items() for f in df.schema.fields if _family(f.dataType)}
    spark = next(iter(tables.values())).sparkSession
    out: dict[tuple[str, str], dict] = {}

    def per_table(of):
        parts = None
        for t, df in tables.items():
            own = [k for k in cols if k[0] == t]
            if own:
                one = of(df, own)
                parts = one if parts is None else parts.unionByName(one)
        return parts

    number = {k: i for i, k in enumerate(cols)}

    def counts(df, own):
        q = {k: F.col(exprs.sql_ident(k[1])) for k in own}
        aggs = [a for k in own for a in (F.count(q[k]).alias(f"n{number[k]}"), F.approx_count_distinct(q[k], 0.02).alias(f"d{number[k]}"))]
        return df.agg(*aggs).select(F.inline(F.array(*[F.struct(F.lit(number[k]).alias("c"), F.col(f"n{number[k]}").alias("n"),
                                                                F.col(f"d{number[k]}").alias("d")) for k in own])))

    names = list(cols)
    found = per_table(counts)
    for r in (found.collect() if found is not None else []):  # one row a column
        k = names[r["c"]]
        theta = min(1.0, size / max(1, r["d"]))
        out[k] = {"family": cols[k][0], "rows": r["n"], "distinct": r["d"], "theta": theta, "hashes": set()}

    def hashes(df, own):
        h = [F.xxhash64(F.col(exprs.sql_ident(k[1])).cast(_FAMILY_TYPE[cols[k][0]])) for k in own]
        passed = [F.when(F.col(exprs.sql_ident(k[1])).isNotNull() & (x <= F.lit(_below(out[k]["theta"]))),
                         F.struct(F.lit(number[k]).alias("c"), x.alias("h"))) for k, x in zip(own, h)]
        return df.select(F.explode(F.array_compact(F.array(*passed))).alias("s")).select("s.c", "s.h").distinct()

    small = per_table(hashes)
    for r in (small.collect() if small is not None else []):  # about `size` rows a column
        out[names[r["c"]]]["hashes"].add(r["h"])
    return out


def _below(theta: float) -> int:
    """Largest hash (a signed long) among the lowest ``theta`` of the range."""
    return min((1 << 63) - 1, int(theta * (1 << 64)) - (1 << 63))


def may_contain(child: dict, parent: dict, least: float) -> bool:
    """Whether the sketches leave room for a containment of ``least``."""
    if child["family"] != parent["family"] or not child["rows"]:
        return False
    if child["distinct"] * least > parent["distinct"] * 1.2 + 10:  # approximate counts, 2 % each
        return False
    limit = _below(min(child["theta"], parent["theta"]))
    sample = [h for h in child["hashes"] if h <= limit]
    if len(sample) < SKETCH_EVIDENCE:
        return True  # too few to tell: counted exactly
    seen = sum(h in parent["hashes"] for h in sample) / len(sample)
    return seen >= least - SKETCH_SIGMAS * (least * (1 - least) / len(sample) + 0.25 / len(sample) ** 2) ** 0.5


def discover_relationships(tables: dict[str, DataFrame], least: float = 0.95, size: int = SKETCH_VALUES) -> DataFrame:
    """D7 without names: every column pair of different tables where the parent
    column is unique and holds at least ``least`` of the child's distinct values.

    Sketches of single columns rule out most pairs (a parent must also be
    nearly unique by its counts); what they leave is counted exactly, all
    values of a family in one stacked list.  Output as
    :func:`key_relationships`, and ``coverage``, the share of the parent's
    values that the child uses."""
    sketches = column_sketches(tables, size)
    parents = [k for k, s in sketches.items() if s["rows"] and s["distinct"] >= 0.85 * s["rows"]]
    pairs = [(a, b) for b in parents for a in sketches if a[0] != b[0] and may_contain(sketches[a], sketches[b], least)]
    columns = {k: tables[k[0]].select(exprs.sql_ident(k[1])) for p in pairs for k in p}
    stats, shared = _exact_figures(columns, pairs)
    pairs = [(a, b) for a, b in pairs if stats[b][1] == 1 and stats[a][0] and shared[a, b] >= least * stats[a][0]]
    spark = next(iter(tables.values())).sparkSession
    coverage = F.try_divide(F.col("matched_values").cast("double"), F.col("parent_values"))
    return _relations(spark, pairs, stats, shared).withColumn("coverage", coverage).drop("parent_values")
