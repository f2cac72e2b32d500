"""DuckDB SQL twins of the profile operators, generated per column list.

Used only as the independent check of the Spark operators: the SQL is
written from the operator's definition, not from the Spark plan.
"""

from __future__ import annotations

from ..functions import exprs, rules

NUM_RE = exprs.NUMBER_TEXT.replace("'", "''")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def parse_sql(c: str) -> str:
    s = f"regexp_replace(CAST({c} AS VARCHAR), '[$,]', '', 'g')"
    return f"(CASE WHEN regexp_matches({s}, '{NUM_RE}') THEN TRY_CAST({s} AS DOUBLE) END)"


def title_sql(e: str) -> str:
    return (f"array_to_string(list_transform(string_split(replace({e}, '_', ' '), ' '), "
            f"lambda w: upper(w[1:1]) || lower(w[2:])), ' ')")


def semantic_sql(name: str = "column_name", dtype: str = "data_type",
                 dc: str = "distinct_count") -> str:
    whens = []
    for sem, pat in rules.SEMANTIC_RULES:
        cond = f"regexp_matches(lower({name}), {q(pat)})"
        if sem == "Boolean":
            cond += f" AND {dc} <= {rules.BOOLEAN_RULE_MAX_DISTINCT}"
        whens.append(f"WHEN {cond} THEN {q(sem)}")
    whens += [f"WHEN {dtype} = 'Boolean' THEN 'Boolean'", f"WHEN {dc} = 2 THEN 'Boolean'",
              f"WHEN {dtype} IN ('Integer', 'Float') THEN 'Number'",
              f"WHEN {dtype} = 'DateTime' THEN 'Date'"]
    return "CASE " + " ".join(whens) + " ELSE 'Text' END"


def _col_profile(i: int, name: str, kind: str, rel: str) -> str:
    c = f'"{name}"'
    n = "count(*)"
    dc = f"count(DISTINCT {c})"
    head = (f"SELECT {i} AS ordinal, {q(name)} AS column_name, {{dtype}} AS data_type, "
            f"{exprs.np_round_sql(f'count_if({c} IS NULL) / {n} * 100.0', 2)} AS null_percentage, "
            f"{dc} AS distinct_count, {exprs.np_round_sql(f'{dc} / {n}', 4)} AS cardinality, ")
    if kind in ("Integer", "Float"):
        body = (f"CASE WHEN {dc} > 0 THEN CAST(min({c}) AS VARCHAR) END AS min_value, "
                f"CASE WHEN {dc} > 0 THEN CAST(max({c}) AS VARCHAR) END AS max_value, "
                f"CASE WHEN {dc} > 0 THEN avg({c}) END AS mean_value, "
                f"CASE WHEN {dc} > 0 THEN quantile_cont(CAST({c} AS DOUBLE), 0.5) END AS median_value, "
                f"CASE WHEN {dc} > 0 THEN stddev_samp({c}) END AS std_dev_value")
        return head.format(dtype=q(kind)) + body + f" FROM {rel}"
    if kind == "Text":
        p = parse_sql(c)
        numeric = f"(count({p}) > {n} * {rules.PARSE_SHARE})"
        pnum = f"({numeric} AND count({p}) > 0)"
        body = (f"CASE WHEN {numeric} THEN (CASE WHEN {pnum} THEN CAST(min({p}) AS VARCHAR) END) "
                f"WHEN {dc} > 0 THEN substr(min(CAST({c} AS VARCHAR)), 1, {rules.PROFILE_TEXT_CHARS}) END AS min_value, "
                f"CASE WHEN {numeric} THEN (CASE WHEN {pnum} THEN CAST(max({p}) AS VARCHAR) END) "
                f"WHEN {dc} > 0 THEN substr(max(CAST({c} AS VARCHAR)), 1, {rules.PROFILE_TEXT_CHARS}) END AS max_value, "
                f"CASE WHEN {pnum} THEN avg({p}) END AS mean_value, "
                f"CASE WHEN {pnum} THEN quantile_cont({p}, 0.5) END AS median_value, "
                f"CASE WHEN {pnum} THEN stddev_samp({p}) END AS std_dev_value")
        dtype = f"CASE WHEN {numeric} THEN 'Float' ELSE 'Text' END"
        return head.format(dtype=dtype) + body + f" FROM {rel}"
    if kind == "Boolean":
        t = f"(CASE WHEN {c} THEN 'True' WHEN NOT {c} THEN 'False' END)"
    else:
        t = f"CAST({c} AS VARCHAR)"
    body = (f"CASE WHEN {dc} > 0 THEN substr(min({t}), 1, {rules.PROFILE_TEXT_CHARS}) END AS min_value, "
            f"CASE WHEN {dc} > 0 THEN substr(max({t}), 1, {rules.PROFILE_TEXT_CHARS}) END AS max_value, "
            f"CAST(NULL AS DOUBLE) AS mean_value, CAST(NULL AS DOUBLE) AS median_value, "
            f"CAST(NULL AS DOUBLE) AS std_dev_value")
    return head.format(dtype=q(kind)) + body + f" FROM {rel}"


def profile_sql(rel: str, cols: list[tuple[str, str]]) -> str:
    """Profile rows (with semantic_type) of relation ``rel``; ``cols`` are
    (name, logical kind) with kind in Integer/Float/DateTime/Boolean/Text."""
    body = " UNION ALL ".join(_col_profile(i, n, k, rel) for i, (n, k) in enumerate(cols))
    return (f"SELECT ordinal, column_name, data_type, {semantic_sql()} AS semantic_type, "
            f"null_percentage, distinct_count, cardinality, min_value, max_value, mean_value, "
            f"median_value, std_dev_value FROM ({body})")


def domain_sql(prof: str) -> str:
    scores = []
    for d, (name, kws) in enumerate(rules.DOMAIN_KEYWORDS):
        found = " + ".join(f"coalesce(max(CAST(contains(lower(column_name), {q(k)}) AS INTEGER)), 0)"
                           for k in kws)
        scores.append(f"SELECT {d} AS rk, {q(name)} AS domain, ({found}) / {float(len(kws))} * 100.0 "
                      f"AS score FROM {prof}")
    best = f"(SELECT * FROM ({' UNION ALL '.join(scores)}) ORDER BY score DESC, rk LIMIT 1)"
    return (f"SELECT CASE WHEN score < {rules.DOMAIN_MIN_SCORE} THEN {q(rules.GENERIC_DOMAIN)} "
            f"ELSE domain END AS domain, CASE WHEN score < {rules.DOMAIN_MIN_SCORE} THEN 100.0 "
            f"ELSE {exprs.np_round_sql('score', 2)} END AS confidence_score FROM {best}")


def ranked_sql(prof: str) -> str:
    return (f"(SELECT *, row_number() OVER (PARTITION BY semantic_type ORDER BY ordinal) AS type_rank "
            f"FROM {prof})")


def kpis_sql(prof: str) -> str:
    r = ranked_sql(prof)
    t = title_sql("column_name")
    return f"""SELECT CAST(row_number() OVER (ORDER BY slot) - 1 AS INTEGER) AS kpi_order, kpi_name, formula FROM (
  SELECT type_rank - 1 AS slot, 'Total ' || {t} AS kpi_name, 'SUM(' || column_name || ')' AS formula
    FROM {r} WHERE semantic_type = 'Monetary' AND type_rank <= 2
  UNION ALL SELECT 2, 'Total ' || {t}, 'SUM(' || column_name || ')'
    FROM {r} WHERE semantic_type = 'Quantity' AND type_rank = 1
  UNION ALL SELECT 3, 'Total Records Volume', coalesce('COUNT(' || min_by(column_name, CASE WHEN contains(lower(column_name), 'id')
        OR contains(lower(column_name), 'code') THEN ordinal END) || ')', 'COUNT(*)') FROM {prof}
  UNION ALL SELECT 4, 'Average ' || {t}, 'AVG(' || column_name || ')'
    FROM {r} WHERE semantic_type = 'Percentage' AND type_rank = 1)"""


def _first_of_sql(types: list[str]) -> str:
    cases = " ".join(f"WHEN {q(t)} THEN {k + 1}" for k, t in enumerate(types))
    return (f"min_by(column_name, CASE semantic_type {cases} END * {1 << 20} + ordinal)")


def picks_sql(prof: str) -> str:
    r = ranked_sql(prof)
    return f"""SELECT {_first_of_sql(["Date"])} AS date_col,
  {_first_of_sql(["Monetary", "Quantity", "Number"])} AS measure_col,
  {_first_of_sql(["Text", "Geographic"])} AS category_col,
  coalesce(min_by(column_name, CASE WHEN semantic_type = 'Geographic' THEN ordinal END),
           min_by(column_name, CASE WHEN semantic_type = 'Text' AND type_rank = 2 THEN ordinal END)) AS bar_col
FROM {r}"""


def charts_sql(prof: str) -> str:
    r = ranked_sql(prof)
    return f"""SELECT * FROM (WITH p AS ({picks_sql(prof)}),
nm AS (SELECT min_by(column_name, CASE WHEN semantic_type = 'Number' AND type_rank = 1 THEN ordinal END) AS n0,
              min_by(column_name, CASE WHEN semantic_type = 'Number' AND type_rank = 2 THEN ordinal END) AS n1,
              min_by(column_name, ordinal) AS first_col, max_by(column_name, ordinal) AS last_col FROM {r}),
c AS (
  SELECT 0 AS slot, 'Line Chart' AS chart_type, {title_sql('measure_col')} || ' Over Time' AS title,
         date_col AS x_axis, measure_col AS y_axis FROM p WHERE date_col IS NOT NULL AND measure_col IS NOT NULL
  UNION ALL SELECT 1, 'Pie Chart', {title_sql('measure_col')} || ' Share by ' || {title_sql('category_col')},
         category_col, measure_col FROM p WHERE category_col IS NOT NULL AND measure_col IS NOT NULL
  UNION ALL SELECT 2, 'Bar Chart', {title_sql('measure_col')} || ' Distribution across ' || {title_sql('category_col')},
         category_col, measure_col FROM p WHERE category_col IS NOT NULL AND measure_col IS NOT NULL
  UNION ALL SELECT 3, 'Scatter Plot', 'Correlation between ' || n0 || ' and ' || n1, n0, n1
         FROM nm WHERE n1 IS NOT NULL),
allc AS (SELECT * FROM c UNION ALL
  SELECT 4, 'Bar Chart', 'Analysis of ' || last_col || ' by ' || first_col, first_col, last_col
  FROM nm WHERE first_col IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c))
SELECT CAST(row_number() OVER (ORDER BY slot) - 1 AS INTEGER) AS chart_order, chart_type, title, x_axis, y_axis
FROM allc)"""
