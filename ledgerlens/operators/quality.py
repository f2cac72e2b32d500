"""Declarative data-quality reports (Q1-Q4).

The reference declares its rules as table constraints (checks, unique,
not-null, foreign keys) that reject bad rows at insert time.  Here the
same rules are reports over DataFrames:

* Q1/Q3: all rules of a table in ONE pass of conditional counts;
* Q2: ``groupBy(key).count() > 1`` (partial aggregation map-side);
* Q4: orphans are found on pre-aggregated keys -- the child side is first
  reduced to (key, rows) with a partial aggregate, then anti-joined with
  the parent's key set; a hot key is one row before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def check_rules(df: DataFrame, table: str, checks: dict[str, Column]) -> DataFrame:
    """Q1: rows breaking each rule (a null check result is not a breach).

    Output: table_name, rule, checked, violations.
    """
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, cond in enumerate(checks.values()):
        aggs.append(F.count_if(~F.coalesce(cond, F.lit(True))).alias(f"_v{i}"))
    parts = [F.struct(F.lit(table).alias("table_name"), F.lit(name).alias("rule"),
                      F.col("_n").alias("checked"), F.col(f"_v{i}").alias("violations"))
             for i, name in enumerate(checks)]
    return df.agg(*aggs).select(F.inline(F.array(*parts)))


def violating_rows(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Q1: the rows that break a rule, with the names of the broken rules."""
    names = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks.items()]),
                     lambda x: x.isNotNull())
    return df.withColumn("broken_rules", names).where(F.size("broken_rules") > 0)


def not_null_report(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Q3: null counts of required columns.  Output: table_name, column_name, checked, nulls."""
    rules = {f"{c} not null": F.col(c).isNotNull() for c in columns}
    out = check_rules(df, table, rules)
    return out.select("table_name", F.regexp_replace("rule", " not null$", "").alias("column_name"),
                      "checked", F.col("violations").alias("nulls"))


def uniqueness_report(df: DataFrame, table: str, key: list[str]) -> DataFrame:
    """Q2: keys that occur more than once.

    Output (one row): table_name, key, duplicate_keys, duplicate_rows.
    """
    dup = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > 1)
    return dup.agg(F.count(F.lit(1)).alias("duplicate_keys"),
                   F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("duplicate_rows")).select(
        F.lit(table).alias("table_name"), F.lit(",".join(key)).alias("key"), "duplicate_keys", "duplicate_rows")


def orphan_report(child: DataFrame, child_table: str, fk: str, parent: DataFrame,
                  parent_table: str, pk: str) -> DataFrame:
    """Q4: child rows whose non-null foreign key has no parent row.

    Output (one row): child_table, fk, parent_table, pk, orphan_keys, orphan_rows.
    """
    keys = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_k")).agg(
        F.count(F.lit(1)).alias("_c"))
    parents = parent.select(F.col(pk).alias("_k")).distinct()
    orphans = keys.join(parents, "_k", "left_anti")
    return orphans.agg(F.count(F.lit(1)).alias("orphan_keys"),
                       F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("orphan_rows")).select(
        F.lit(child_table).alias("child_table"), F.lit(fk).alias("fk"), F.lit(parent_table).alias("parent_table"),
        F.lit(pk).alias("pk"), "orphan_keys", "orphan_rows")
