"""Column profiling and metadata rules.

``profile(df)`` computes every statistic of every column in ONE aggregate
(partial aggregation per partition, one final row) and unpivots it into
one row per column with ``inline`` -- nothing but that single row of
aggregates reaches the final task, and the result stays a DataFrame.
The rule operators (semantic type, domain, KPI and chart suggestions)
run on that small profile DataFrame (one row per column).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import exprs, rules
from ..session import stage

PROFILE_SCHEMA = ("ordinal int, column_name string, data_type string, semantic_type string, "
                  "null_percentage double, distinct_count long, cardinality double, "
                  "min_value string, max_value string, mean_value double, "
                  "median_value double, std_dev_value double")

# Codes of a value that crosses joins in the value's place (value_codes).
CODES = 256


def _distinct(c: Column, approx: bool) -> Column:
    return F.approx_count_distinct(c, 0.01) if approx else F.count_distinct(c)


def _median(c: Column, approx: bool) -> Column:
    return F.percentile_approx(c, 0.5, 10000).cast("double") if approx else F.median(c)


def _exact_medians(df: DataFrame, numeric_texts: set[int], distinct: dict[int, int]) -> dict[int, float | None]:
    """Exact medians of the numeric columns and of the text columns that hold
    numbers (by position); ``distinct``: their numbers of distinct values."""
    from .quantiles import exact_quantiles
    cols = {}
    for i, f in enumerate(df.schema.fields):
        kind = exprs.logical_type(f.dataType)
        c = F.col(f"`{f.name}`")
        if kind in ("Integer", "Float"):
            cols[i] = c
        elif i in numeric_texts:
            cols[i] = F.expr(exprs.parse_number_sql(exprs.sql_ident(f.name)))
    got = exact_quantiles(df, {str(i): e for i, e in cols.items()}, [0.5], distinct={str(i): distinct[i] for i in cols})
    return {int(k): v[0] for k, v in got.items()}


def profile(df: DataFrame, approx: bool = False, materialize: bool = False) -> DataFrame:
    """One profile row per column, in column order.

    Medians come from the exact bounded-memory selection (a few passes of
    the numeric columns); ``approx=True`` swaps the exact distinct count
    and median for HyperLogLog++ and ``percentile_approx`` (one pass).
    ``materialize=True`` (for inputs built by joins) writes the input once
    to the shared folder so the passes scan files instead of re-joining.
    The profile itself (one row per column, bounded by the schema) is
    computed once, so the rule operators that read it in several branches
    do not recompute it.
    """
    df = exprs.nan_to_null(df)
    if materialize:
        df = stage(df, "profile-input")
    fields = df.schema.fields
    q, S, D = exprs.sql_ident, exprs.sql_str, exprs.sql_double
    # positional names, the numeric reading of text columns parsed once
    cols = [f"c{i}" for i in range(len(fields))]
    kinds = [exprs.logical_type(f.dataType) for f in fields]
    # distinct values first: they tell which text columns hold numbers at all,
    # so the passes over the rows parse no others
    found = {} if approx else value_tallies(df, {i: q(f.name) for i, f in enumerate(fields)})
    parsed = {i for i, k in enumerate(kinds) if k is None and (approx or found[i]["numbers"])}
    meds = {} if approx else _exact_medians(df, parsed, {i: t["n"] for i, t in found.items()})
    proj = [f"{q(f.name)} AS c{i}" for i, f in enumerate(fields)]
    proj += [f"{exprs.parse_number_sql(q(f.name))} AS p{i}"
             for i, f in enumerate(fields) if i in parsed]
    base = df.selectExpr(*proj)

    def med(i):
        return f"CAST(percentile_approx(CAST(c{i} AS DOUBLE), 0.5, 10000) AS DOUBLE)" if approx \
            else f"CAST({D(meds[i]) if meds.get(i) is not None else 'NULL'} AS DOUBLE)"

    def text_of(e, dt):
        if isinstance(dt, T.BooleanType):
            return f"CASE WHEN {e} THEN 'True' WHEN NOT {e} THEN 'False' END"
        return f"CAST({e} AS STRING)"

    aggs = ["count(1) AS _n"]
    for i, f in enumerate(fields):
        c, kind = cols[i], kinds[i]
        aggs.append(f"count_if({c} IS NULL) AS _z{i}")
        aggs.append((f"approx_count_distinct({c}, 0.01)" if approx else f"CAST({found[i]['n']} AS BIGINT)") + f" AS _d{i}")
        if kind in ("Integer", "Float"):
            aggs += [f"CAST(min({c}) AS STRING) AS _lo{i}", f"CAST(max({c}) AS STRING) AS _hi{i}",
                     f"avg({c}) AS _mu{i}", f"{med(i)} AS _me{i}", f"stddev_samp({c}) AS _sd{i}"]
        elif kind is None:
            # text: maybe numeric text ($ and , stripped); keep both readings
            ends = ([f"min(CAST({c} AS STRING)) AS _lo{i}", f"max(CAST({c} AS STRING)) AS _hi{i}"] if approx else
                    [f"CAST({'NULL' if found[i][e] is None else S(found[i][e])} AS STRING) AS _{e}{i}" for e in ("lo", "hi")])
            if i not in parsed:
                aggs += [f"CAST(0 AS BIGINT) AS _p{i}", *ends]
                aggs += [f"CAST(NULL AS {t}) AS _{s}{i}" for s, t in
                         (("plo", "STRING"), ("phi", "STRING"), ("pmu", "DOUBLE"), ("pme", "DOUBLE"), ("psd", "DOUBLE"))]
                continue
            x = f"p{i}"
            pmed = f"CAST(percentile_approx({x}, 0.5, 10000) AS DOUBLE)" if approx else med(i)
            aggs += [f"count({x}) AS _p{i}", f"CAST(min({x}) AS STRING) AS _plo{i}",
                     f"CAST(max({x}) AS STRING) AS _phi{i}", f"avg({x}) AS _pmu{i}",
                     f"{pmed} AS _pme{i}", f"stddev_samp({x}) AS _psd{i}", *ends]
        else:
            # min/max of the typed value, then its text: same order as the
            # text form for timestamps and booleans, without a cast per row
            aggs += [f"{text_of(f'min({c})', f.dataType)} AS _lo{i}",
                     f"{text_of(f'max({c})', f.dataType)} AS _hi{i}"]
    row = base.selectExpr(*aggs)

    nd = "CAST(_n AS DOUBLE)"
    k = rules.PROFILE_TEXT_CHARS
    parts = []
    for i, f in enumerate(fields):
        kind = kinds[i]
        dc = f"CAST(_d{i} AS BIGINT)"
        has = f"({dc} > 0)"
        nul = f"CASE WHEN _n > 0 THEN {exprs.np_round_text(f'_z{i} / {nd} * {D(100.0)}', 2)} ELSE CAST('NaN' AS DOUBLE) END"
        card = f"CASE WHEN _n > 0 THEN {exprs.np_round_text(f'{dc} / {nd}', 4)} ELSE {D(0.0)} END"
        cut = lambda e: f"substring({e}, 1, {k})"
        if kind in ("Integer", "Float"):
            dtype = S(kind)
            lo, hi = f"CASE WHEN {has} THEN _lo{i} END", f"CASE WHEN {has} THEN _hi{i} END"
            mu, me, sd = (f"CASE WHEN {has} THEN _mu{i} END", f"CASE WHEN {has} THEN _me{i} END",
                          f"CASE WHEN {has} THEN _sd{i} END")
        elif kind is None:
            numeric = f"(_p{i} > {nd} * {D(rules.PARSE_SHARE)})"
            dtype = f"CASE WHEN {numeric} THEN 'Float' ELSE 'Text' END"
            pnum = f"({numeric} AND _p{i} > 0)"
            lo = (f"CASE WHEN {numeric} THEN (CASE WHEN {pnum} THEN _plo{i} END) "
                  f"ELSE (CASE WHEN {has} THEN {cut(f'_lo{i}')} END) END")
            hi = (f"CASE WHEN {numeric} THEN (CASE WHEN {pnum} THEN _phi{i} END) "
                  f"ELSE (CASE WHEN {has} THEN {cut(f'_hi{i}')} END) END")
            mu = f"CASE WHEN {pnum} THEN _pmu{i} END"
            me = f"CASE WHEN {pnum} THEN _pme{i} END"
            sd = f"CASE WHEN {pnum} THEN _psd{i} END"
        else:
            dtype = S(kind)
            lo, hi = f"CASE WHEN {has} THEN {cut(f'_lo{i}')} END", f"CASE WHEN {has} THEN {cut(f'_hi{i}')} END"
            mu = me = sd = "NULL"
        parts.append(
            f"named_struct('ordinal', {i}, 'column_name', {S(f.name)}, 'data_type', {dtype}, "
            f"'null_percentage', CAST({nul} AS DOUBLE), 'distinct_count', {dc}, "
            f"'cardinality', CAST({card} AS DOUBLE), 'min_value', CAST({lo} AS STRING), "
            f"'max_value', CAST({hi} AS STRING), 'mean_value', CAST({mu} AS DOUBLE), "
            f"'median_value', CAST({me} AS DOUBLE), 'std_dev_value', CAST({sd} AS DOUBLE))")
    prof = row.selectExpr(f"inline(array({', '.join(parts)}))")
    prof = prof.withColumn("semantic_type", semantic_type(F.col("column_name"), F.col("data_type"),
                                                          F.col("distinct_count")))
    prof = prof.select("ordinal", "column_name", "data_type", "semantic_type", "null_percentage",
                       "distinct_count", "cardinality", "min_value", "max_value", "mean_value",
                       "median_value", "std_dev_value")
    # metadata, one row per column (bounded by the schema, not the data):
    # computed once here, then reused by every rule branch downstream
    return df.sparkSession.createDataFrame(prof.collect(), prof.schema)


def distinct_counts(df: DataFrame, exprs_by_key: dict[int, str]) -> dict[int, int]:
    """Exact distinct counts of many expressions over a written table."""
    return {k: r["n"] for k, r in value_tallies(df, exprs_by_key).items()}


def value_tallies(df: DataFrame, exprs_by_key: dict[int, str]) -> dict[int, dict]:
    """Of each expression over a written table: ``n`` distinct values and, of
    text, ``numbers`` (rows that read as a number) and the ends ``lo`` and ``hi``
    (cut to the profile's length).

    Each expression is grouped by itself, on values of its own type: a branch
    scans one column, and only its distinct values of a task are shuffled.
    Numbers are read once per distinct text."""
    if not exprs_by_key:
        return {}
    types = df.selectExpr(*[f"{e} AS _{k}" for k, e in exprs_by_key.items()]).schema
    cut = rules.PROFILE_TEXT_CHARS
    branches = []
    for (k, e), f in zip(exprs_by_key.items(), types.fields):
        kind = exprs.logical_type(f.dataType)
        if kind is None:
            v = df.selectExpr(f"CAST({e} AS STRING) AS v").where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
            row = [f"coalesce(sum(CASE WHEN {exprs.parse_number_sql('v')} IS NOT NULL THEN c END), 0) AS numbers",
                   f"substring(min(v), 1, {cut}) AS lo", f"substring(max(v), 1, {cut}) AS hi"]
        else:
            # both zeros of a double are values of their own, as in their texts
            zero = ["CASE WHEN v = 0 THEN CAST(v AS STRING) END AS z"] if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else []
            v = df.selectExpr(f"{e} AS v").where("v IS NOT NULL").selectExpr("v", *zero).distinct()
            row = ["CAST(0 AS BIGINT) AS numbers", "CAST(NULL AS STRING) AS lo", "CAST(NULL AS STRING) AS hi"]
        branches.append(v.selectExpr("count(1) AS n", *row).selectExpr(f"{k} AS k", "*"))
    every = branches[0]
    for b in branches[1:]:
        every = every.unionByName(b)
    return {r["k"]: r.asDict() for r in every.collect()}  # one row per expression


def column_names(df: DataFrame) -> DataFrame:
    """ordinal, column_name: all that P8 needs, from the schema alone."""
    return df.sparkSession.createDataFrame(list(enumerate(df.columns)), "ordinal int, column_name string")


def column_metadata(df: DataFrame, coded: DataFrame | None = None,
                    own: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """P4 + P7 without the statistics: ordinal, column_name, data_type,
    semantic_type, one row per column.

    Only columns that a name rule does not decide are read, in one pass (the
    input may be a join): (column, value) pairs are grouped, and the groups tell
    the distinct counts and, of text columns, the share of numbers.

    ``coded``: the same rows with the columns replaced by :func:`value_codes`
    before they were joined; then no value crosses a join, and ``df`` itself is
    read only for columns whose few codes stand for more values in the table
    they come from, which ``own(name)`` gives."""
    df = exprs.nan_to_null(df)
    open_ = [i for i, f in enumerate(df.schema.fields) if _by_name(f.name) is None]
    kinds = {i: exprs.logical_type(f.dataType) for i, f in enumerate(df.schema.fields)}
    if coded is None:
        found = _paired_tallies(df, open_, kinds)
    else:
        found, doubtful = _coded_tallies(df, open_, coded, own)
        found.update(_paired_tallies(df, doubtful, kinds))
    rows = []
    for i, name in enumerate(df.columns):
        r = found.get(i)
        numeric = r is not None and (r["numbers"] or 0) > r["rows"] * rules.PARSE_SHARE
        distinct = (r["n"] if r else 0) if i in open_ else None
        rows.append((i, name, kinds[i] or ("Float" if numeric else "Text"), distinct))
    meta = df.sparkSession.createDataFrame(rows, "ordinal int, column_name string, data_type string, distinct_count long")
    return meta.withColumn("semantic_type", semantic_type(F.col("column_name"), F.col("data_type"), F.col("distinct_count"))
                           ).select("ordinal", "column_name", "data_type", "semantic_type")


def _paired_tallies(df: DataFrame, open_: list[int], kinds: dict[int, str | None]) -> dict:
    """Of the columns at ``open_``: ``rows``, ``n`` distinct values, ``numbers`` of text."""
    if not open_:
        return {}
    q = exprs.sql_ident
    pairs = ", ".join(f"named_struct('k', {i}, 'v', CAST({q(df.columns[i])} AS STRING))" for i in open_)
    texts = ", ".join(str(i) for i in open_ if kinds[i] is None) or "NULL"
    return {r["k"]: r for r in (  # one row per column
        df.selectExpr(f"inline(array({pairs}))").groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
          .groupBy("k").agg(F.sum("c").alias("rows"), F.count("v").alias("n"), F.expr(
              f"sum(CASE WHEN k IN ({texts}) AND {exprs.parse_number_sql('v')} IS NOT NULL THEN c END)").alias("numbers")).collect())}


def _code_sql(name: str, dtype: T.DataType) -> str:
    v = exprs.sql_ident(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        v = f"nanvl({v}, NULL)"
    number = f"CASE WHEN {exprs.parse_number_sql(v)} IS NOT NULL THEN {CODES} ELSE 0 END" \
        if exprs.logical_type(dtype) is None else "0"
    return f"CASE WHEN {v} IS NOT NULL THEN CAST(pmod(xxhash64(CAST({v} AS STRING)), {CODES}) + {number} AS SMALLINT) END"


def value_codes(table: DataFrame, names: list[str]) -> DataFrame:
    """``table`` with each of the columns ``names`` replaced by a small code of
    its value: one of ``CODES`` by its hash, and ``CODES`` more for a text that
    reads as a number.  Equal values have equal codes, nulls none; columns that
    a name rule decides are left out."""
    open_ = {c for c in names if _by_name(c) is None}
    return table.selectExpr(*[
        f"{_code_sql(f.name, f.dataType)} AS {exprs.sql_ident(f.name)}" if f.name in open_ else exprs.sql_ident(f.name)
        for f in table.schema.fields if f.name in open_ or f.name not in names])


def _coded_tallies(df: DataFrame, open_: list[int], coded: DataFrame, own: Callable[[str], DataFrame]) -> tuple[dict, list[int]]:
    """Tallies by the codes in ``coded``, and the columns they leave in doubt.

    Different codes are different values, so more codes than any rule asks for
    settle a column.  Fewer are counted as values only if in the column's own
    table, too, each of them stands for one value."""
    if not open_:
        return {}, []
    q = exprs.sql_ident
    pairs = ", ".join(f"named_struct('k', {i}, 'v', {q(df.columns[i])})" for i in open_)
    found = {i: {"rows": 0, "n": 0, "numbers": 0} for i in open_}
    seen: dict[int, list[int]] = {i: [] for i in open_}
    # at most 2 * CODES + 1 rows a column
    for r in coded.selectExpr(f"inline(array({pairs}))").groupBy("k", "v").agg(F.count(F.lit(1)).alias("c")).collect():
        t = found[r["k"]]
        t["rows"] += r["c"]
        if r["v"] is not None:
            t["n"] += 1
            t["numbers"] += r["c"] if r["v"] >= CODES else 0
            seen[r["k"]].append(r["v"])
    branches = []
    for i in open_:
        if 0 < found[i]["n"] <= rules.BOOLEAN_RULE_MAX_DISTINCT:
            name = df.columns[i]
            values = own(name)
            code = _code_sql(name, values.schema[0].dataType)
            branches.append(values.where(f"{code} IN ({', '.join(map(str, seen[i]))})").selectExpr(f"CAST({q(name)} AS STRING) AS v")
                            .distinct().selectExpr(f"{i} AS k", "count(1) AS n"))
    held = reduce(DataFrame.unionAll, branches).collect() if branches else []  # one row per column
    return found, [r["k"] for r in held if r["n"] > found[r["k"]]["n"]]


def _by_name(name: str) -> str | None:
    """The semantic type a name decides whatever the column holds."""
    for sem, pattern in rules.SEMANTIC_RULES:
        if re.search(pattern, name.lower()):
            return None if sem == "Boolean" else sem
    return None


def semantic_type(name: Column, data_type: Column, distinct_count: Column) -> Column:
    """First matching name rule, then type/cardinality fallbacks."""
    low = F.lower(name)
    out = None
    for sem, pattern in rules.SEMANTIC_RULES:
        cond = low.rlike(pattern)
        if sem == "Boolean":
            cond = cond & (distinct_count <= rules.BOOLEAN_RULE_MAX_DISTINCT)
        out = F.when(cond, F.lit(sem)) if out is None else out.when(cond, F.lit(sem))
    return (out.when(data_type == "Boolean", F.lit("Boolean"))
               .when(distinct_count == 2, F.lit("Boolean"))
               .when(data_type.isin("Integer", "Float"), F.lit("Number"))
               .when(data_type == "DateTime", F.lit("Date"))
               .otherwise(F.lit("Text")))


def classify_domain(prof: DataFrame) -> DataFrame:
    """Business domain and confidence from column names.

    Output (one row): domain, confidence_score.
    """
    low = F.lower(F.col("column_name"))
    aggs = []
    for d, (_, kws) in enumerate(rules.DOMAIN_KEYWORDS):
        for j, kw in enumerate(kws):
            aggs.append(F.max(low.contains(kw).cast("int")).alias(f"_h{d}_{j}"))
    hits = prof.agg(*aggs)
    cand = []
    for d, (name, kws) in enumerate(rules.DOMAIN_KEYWORDS):
        found = sum((F.coalesce(F.col(f"_h{d}_{j}"), F.lit(0)) for j in range(len(kws))), F.lit(0))
        score = found / F.lit(float(len(kws))) * F.lit(100.0)
        # highest score wins; on ties the earlier domain (larger -d) wins
        cand.append(F.struct(score.alias("score"), F.lit(-d).alias("rank"), F.lit(name).alias("domain")))
    best = hits.select(F.array_max(F.array(*cand)).alias("b"))
    low_score = F.col("b.score") < rules.DOMAIN_MIN_SCORE
    return best.select(
        F.when(low_score, F.lit(rules.GENERIC_DOMAIN)).otherwise(F.col("b.domain")).alias("domain"),
        F.when(low_score, F.lit(100.0)).otherwise(exprs.np_round(F.col("b.score"), 2))
        .alias("confidence_score"))


def _ranked(prof: DataFrame) -> DataFrame:
    """Profile rows with their position among columns of the same semantic type."""
    w = Window.partitionBy("semantic_type").orderBy("ordinal")  # profile: one row per column
    return prof.withColumn("type_rank", F.row_number().over(w))


def _first_of(prof: DataFrame, types: list[str], alias: str) -> Column:
    """Column name of the first column (by ``types`` preference, then order)."""
    pref = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("semantic_type"))
    key = F.when(pref > 0, pref * F.lit(1 << 20) + F.col("ordinal"))
    return F.min_by(F.col("column_name"), key).alias(alias)


def _pick_aggs(prof: DataFrame) -> list[Column]:
    text2 = F.min_by(F.col("column_name"),
                     F.when((F.col("semantic_type") == "Text") & (F.col("type_rank") == 2),
                            F.col("ordinal")))
    return [
        _first_of(prof, ["Date"], "date_col"),
        _first_of(prof, ["Monetary", "Quantity", "Number"], "measure_col"),
        _first_of(prof, ["Text", "Geographic"], "category_col"),
        F.coalesce(F.min_by(F.col("column_name"),
                            F.when(F.col("semantic_type") == "Geographic", F.col("ordinal"))),
                   text2).alias("bar_col")]


def pick_columns(prof: DataFrame) -> DataFrame:
    """Measure, category and bar columns of the dashboard, plus the date.

    Output (one row): date_col, measure_col, category_col, bar_col.
    """
    return _ranked(prof).agg(*_pick_aggs(prof))


def one_row(*frames: DataFrame) -> DataFrame:
    """Put the columns of several one-row DataFrames side by side.

    A union plus a global ``first(ignorenulls)`` -- no join is needed to
    combine single-row aggregates.
    """
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    q = exprs.sql_ident
    return u.selectExpr(*[f"first({q(c)}, true) AS {q(c)}" for c in u.columns])


def suggest_kpis(prof: DataFrame) -> DataFrame:
    """KPI formulas.  Output: kpi_order, kpi_name, formula."""
    r = _ranked(prof)
    title = exprs.title_words(F.col("column_name"))
    name = F.col("column_name")
    mon = r.where((F.col("semantic_type") == "Monetary") & (F.col("type_rank") <= 2)).select(
        (F.col("type_rank") - 1).alias("slot"), F.concat(F.lit("Total "), title).alias("kpi_name"),
        F.concat(F.lit("SUM("), name, F.lit(")")).alias("formula"))
    qty = r.where((F.col("semantic_type") == "Quantity") & (F.col("type_rank") == 1)).select(
        F.lit(2).alias("slot"), F.concat(F.lit("Total "), title).alias("kpi_name"),
        F.concat(F.lit("SUM("), name, F.lit(")")).alias("formula"))
    low = F.lower(name)
    ids = prof.agg(F.min_by(name, F.when(low.contains("id") | low.contains("code"),
                                         F.col("ordinal"))).alias("c"))
    cnt = ids.select(F.lit(3).alias("slot"), F.lit("Total Records Volume").alias("kpi_name"),
                     F.when(F.col("c").isNotNull(), F.concat(F.lit("COUNT("), F.col("c"), F.lit(")")))
                      .otherwise(F.lit("COUNT(*)")).alias("formula"))
    pct = r.where((F.col("semantic_type") == "Percentage") & (F.col("type_rank") == 1)).select(
        F.lit(4).alias("slot"), F.concat(F.lit("Average "), title).alias("kpi_name"),
        F.concat(F.lit("AVG("), name, F.lit(")")).alias("formula"))
    allk = mon.unionByName(qty).unionByName(cnt).unionByName(pct)
    return allk.select((F.row_number().over(Window.orderBy("slot")) - 1).cast("int").alias("kpi_order"),
                       "kpi_name", "formula")


def suggest_charts(prof: DataFrame) -> DataFrame:
    """P10: chart specs.  Output: chart_order, chart_type, title, x_axis, y_axis."""
    r = _ranked(prof)
    j = r.agg(
        *_pick_aggs(prof),
        F.min_by("column_name", F.when((F.col("semantic_type") == "Number") & (F.col("type_rank") == 1),
                                       F.col("ordinal"))).alias("n0"),
        F.min_by("column_name", F.when((F.col("semantic_type") == "Number") & (F.col("type_rank") == 2),
                                       F.col("ordinal"))).alias("n1"),
        F.min_by("column_name", F.col("ordinal")).alias("first_col"),
        F.max_by("column_name", F.col("ordinal")).alias("last_col"))
    m, c, d = F.col("measure_col"), F.col("category_col"), F.col("date_col")
    tm, tc = exprs.title_words(m), exprs.title_words(c)
    def spec(slot, kind, title, x, y, ok):
        return F.struct(F.lit(slot).alias("slot"), F.lit(kind).alias("chart_type"),
                        title.alias("title"), x.alias("x_axis"), y.alias("y_axis"), ok.alias("ok"))
    specs = F.array(
        spec(0, "Line Chart", F.concat(tm, F.lit(" Over Time")), d, m, d.isNotNull() & m.isNotNull()),
        spec(1, "Pie Chart", F.concat(tm, F.lit(" Share by "), tc), c, m, c.isNotNull() & m.isNotNull()),
        spec(2, "Bar Chart", F.concat(tm, F.lit(" Distribution across "), tc), c, m,
             c.isNotNull() & m.isNotNull()),
        spec(3, "Scatter Plot", F.concat(F.lit("Correlation between "), F.col("n0"), F.lit(" and "),
                                         F.col("n1")), F.col("n0"), F.col("n1"), F.col("n1").isNotNull()))
    fallback = F.struct(F.lit(4).alias("slot"), F.lit("Bar Chart").alias("chart_type"),
                        F.concat(F.lit("Analysis of "), F.col("last_col"), F.lit(" by "),
                                 F.col("first_col")).alias("title"),
                        F.col("first_col").alias("x_axis"), F.col("last_col").alias("y_axis"),
                        F.col("first_col").isNotNull().alias("ok"))
    chosen = F.filter(specs, lambda s: s["ok"])
    out = j.select(F.when(F.size(chosen) > 0, chosen).otherwise(F.array(fallback)).alias("c"))
    out = out.select(F.inline("c")).where(F.col("ok"))
    return out.select((F.row_number().over(Window.orderBy("slot")) - 1).cast("int").alias("chart_order"),
                      "chart_type", "title", "x_axis", "y_axis")


def ingest_insights(prof: DataFrame, domain: DataFrame, records: DataFrame) -> DataFrame:
    """P12 + P13: domain line, volume line, null warning.

    ``records`` is a one-row DataFrame with column ``n`` (rows ingested).
    Output: insight_order, text.
    """
    info = prof.agg(
        F.count(F.lit(1)).alias("ncols"),
        F.sort_array(F.collect_list(F.when(F.col("null_percentage") > rules.NULL_WARN_PCT,
                                           F.struct("ordinal", "column_name")))).alias("nulls"))
    j = one_row(domain, info, records)
    warn_cols = F.array_join(F.transform(F.slice(F.col("nulls"), 1, rules.NULL_WARN_NAMES),
                                         lambda s: s["column_name"]), ", ")
    lines = F.array(
        F.struct(F.lit(0).alias("insight_order"),
                 F.format_string("Successfully identified dataset domain as **%s** with **%s%%** confidence.",
                                 F.col("domain"), F.col("confidence_score").cast("string")).alias("text")),
        F.struct(F.lit(1).alias("insight_order"),
                 F.format_string("Ingested **%s** records across **%s** distinct column fields.",
                                 exprs.grouped(F.col("n"), 0), F.col("ncols").cast("string")).alias("text")),
        F.struct(F.lit(2).alias("insight_order"), F.when(F.size("nulls") > 0, F.format_string(
            "**WARNING**: Columns (%s) contain high missing value percentages. "
            "Mode/median substitution applied.", warn_cols)).alias("text")))
    return j.select(F.inline(lines)).where(F.col("text").isNotNull())
