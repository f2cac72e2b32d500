"""Daily forecasting.

Data volume is reduced first: one ``groupBy(series, day)`` turns the
table into daily totals, so everything after works on one row per series
and day (bounded by the calendar, not by the table).  The gap-filled
series of each group is folded with Spark's higher-order ``aggregate``
over a grid of smoothing parameters (JVM-side, no Python UDF); the best
cell by squared error gives the final level/trend, the residual spread
and the error measure.  Many series run in parallel, one group each.

Model (Holt's additive trend, no season): state before the first day is
level y0 and trend y1 - y0; for each day the one-step fit is l + b, then
l' = a*y + (1-a)*(l+b) and b' = g*(l' - l) + (1-g)*b.  The reference's
library also optimises the initial state with a continuous optimiser;
this grid (steps of 1/20 for both parameters) is close but not equal.
``holt_estimated`` estimates all four, many series side by side.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import exprs, rules
from ..session import stage

GRID_STEPS = 20  # a, g in {1/20, ..., 19/20}


def daily_totals(df: DataFrame, date_col: str, value_col: str, series_col: str | None = None) -> DataFrame:
    """SUM(value) by series and calendar day.  Output: sid, d, y."""
    sid = F.col(series_col).cast("string") if series_col else F.lit("all")
    return (df.groupBy(sid.alias("sid"), F.to_date(F.col(date_col)).alias("d"))
              .agg(F.sum(F.col(value_col)).cast("double").alias("y"))
              .where(F.col("d").isNotNull()))


def fill_days(daily: DataFrame) -> DataFrame:
    """every day between a series' first and last day; missing -> 0."""
    daily = stage(daily, "daily-totals")
    cal = (daily.groupBy("sid").agg(F.min("d").alias("d0"), F.max("d").alias("d1"))
                .select("sid", F.explode(F.sequence("d0", "d1", F.expr("INTERVAL 1 DAY"))).alias("d")))
    filled = cal.join(daily, ["sid", "d"], "left").fillna(0.0, subset=["y"])
    # calendar-sized; history, fits and counts all read this one written table
    return stage(filled, "daily-series")


def _fold(pts: Column, a: Column, g: Column) -> Column:
    y0 = F.element_at(pts, 1)["y"]
    y1 = F.coalesce(F.element_at(pts, 2)["y"], y0)
    zero = F.lit(0.0)
    init = F.struct(y0.alias("l"), (y1 - y0).alias("b"), zero.alias("sse"), zero.alias("sr"),
                    zero.alias("ape"), F.lit(0).alias("apn"), F.lit(0).alias("i"))

    def step(acc, p):
        f = acc["l"] + acc["b"]
        r = p["y"] - f
        l2 = a * p["y"] + (F.lit(1.0) - a) * f
        b2 = g * (l2 - acc["l"]) + (F.lit(1.0) - g) * acc["b"]
        use = (acc["i"] >= 1) & (p["y"] > 0)
        return F.struct(l2.alias("l"), b2.alias("b"), (acc["sse"] + r * r).alias("sse"),
                        (acc["sr"] + r).alias("sr"),
                        F.when(use, acc["ape"] + F.abs(r) / p["y"]).otherwise(acc["ape"]).alias("ape"),
                        F.when(use, acc["apn"] + 1).otherwise(acc["apn"]).alias("apn"),
                        (acc["i"] + 1).alias("i"))
    return F.aggregate(pts, init, step)


def holt_fit(filled: DataFrame, min_days: int = rules.HOLT_MIN_DAYS) -> DataFrame:
    """best (a, g) per series.

    Output: sid, n, last_date, alpha, beta, level, trend, sse, sigma, mape_raw.
    Series shorter than ``min_days`` are left to the linear fallback.
    """
    # one array per series: its length is the series' day count
    ser = filled.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("d", "y"))).alias("pts"),
                                    F.max("d").alias("last_date"), F.count(F.lit(1)).alias("n"))
    ser = ser.where(F.col("n") >= min_days)
    grid = F.array(*[F.struct(F.lit(i).alias("ia"), F.lit(j).alias("ig"))
                     for i in range(1, GRID_STEPS) for j in range(1, GRID_STEPS)])
    cells = ser.select("sid", "n", "last_date", "pts", F.explode(grid).alias("c"))
    a = F.col("c.ia") / F.lit(float(GRID_STEPS))
    g = F.col("c.ig") / F.lit(float(GRID_STEPS))
    fitted = cells.select("sid", "n", "last_date", a.alias("alpha"), g.alias("beta"),
                          _fold(F.col("pts"), a, g).alias("s"))
    best = fitted.groupBy("sid", "n", "last_date").agg(
        F.min_by(F.struct("alpha", "beta", "s"), F.struct(F.col("s.sse"), "alpha", "beta")).alias("m"))
    n = F.col("n").cast("double")
    mean_r = F.col("m.s.sr") / n
    var = F.col("m.s.sse") / n - mean_r * mean_r
    return best.select(
        "sid", "n", "last_date", F.col("m.alpha").alias("alpha"), F.col("m.beta").alias("beta"),
        F.col("m.s.l").alias("level"), F.col("m.s.b").alias("trend"),
        F.col("m.s.sse").alias("sse"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sigma"),
        F.when(F.col("m.s.apn") > 0, F.col("m.s.ape") / F.col("m.s.apn") * 100.0).alias("mape_raw"))


# Box of the estimated smoothing parameters, and where refining their steps ends.
HOLT_LEAST, HOLT_MOST = 1e-4, 1.0 - 1e-4
HOLT_STEP = 1e-7
HOLT_ROUNDS = 200
ESTIMATED = ("sid string, n long, last_date date, alpha double, beta double, level0 double, trend0 double, level double,"
             " trend double, sse double, sigma double, mape_raw double")


def _profiled(y: np.ndarray, a: np.ndarray, g: np.ndarray):
    """Least squared error of each (a, g) over all initial states, and the state.

    One-step errors are linear in the initial level and trend: e = e0 - l0*u -
    b0*v, where e0 is the error from a zero state and u, v those a unit level
    and a unit trend leave.  The best state solves two normal equations."""
    z, o = np.zeros_like(a), np.ones_like(a)
    l0, b0, lu, bu, lv, bv = z, z, o, z, z, o
    suu, suv, svv, sue, sve = (np.zeros_like(a) for _ in range(5))
    for x in y:
        f, u, v = l0 + b0, lu + bu, lv + bv
        e = x - f
        suu, suv, svv, sue, sve = suu + u * u, suv + u * v, svv + v * v, sue + u * e, sve + v * e
        n0, nu, nv = f + a * e, u - a * u, v - a * v
        b0, bu, bv = g * (n0 - l0) + (1 - g) * b0, g * (nu - lu) + (1 - g) * bu, g * (nv - lv) + (1 - g) * bv
        l0, lu, lv = n0, nu, nv
    det = suu * svv - suv * suv
    fine = det > 1e-12 * suu * svv
    safe = np.where(fine, det, 1.0)
    level = np.where(fine, (svv * sue - suv * sve) / safe, np.where(suu > 0, sue / np.where(suu > 0, suu, 1.0), y[0]))
    trend = np.where(fine, (suu * sve - suv * sue) / safe, 0.0)
    return level, trend


def _run(y: np.ndarray, a, g, level, trend):
    """The recursion from given states: squared error, sum of errors, final state."""
    l, b, sse, total = level, trend, np.zeros_like(a), np.zeros_like(a)
    for x in y:
        f = l + b
        e = x - f
        sse, total = sse + e * e, total + e
        after = f + a * e
        b = g * (after - l) + (1 - g) * b
        l = after
    return sse, total, l, b


def estimate_holt(y: np.ndarray) -> dict:
    """Smoothing parameters and initial state of least squared one-step error.

    The state is solved exactly for every (alpha, beta); those two are found by
    a search over the grid's cells, then over ever finer steps around the best,
    moving on while the best lies at the edge.  The grid's own start state is
    kept where it is no worse, so the result is never above the grid's."""
    y = np.asarray(y, float)
    steps = np.arange(1, GRID_STEPS) / GRID_STEPS

    def tried(a, g):
        a, g = (x.ravel() for x in np.meshgrid(np.unique(a), np.unique(g), indexing="ij"))
        level, trend = _profiled(y, a, g)
        sse, *_ = _run(y, a, g, level, trend)
        plain = np.full_like(a, y[0]), np.full_like(a, (y[1] if len(y) > 1 else y[0]) - y[0])
        other, *_ = _run(y, a, g, *plain)
        use = other < sse
        sse = np.where(use, other, sse)
        k = int(np.argmin(sse))
        return sse[k], a[k], g[k], np.where(use, plain[0], level)[k], np.where(use, plain[1], trend)[k]

    best, step = tried(steps, steps), 1 / GRID_STEPS
    around = np.arange(-3, 4) / 3
    for _ in range(HOLT_ROUNDS):
        if step < HOLT_STEP:
            break
        a, g = (np.clip(x + around * step, HOLT_LEAST, HOLT_MOST) for x in best[1:3])
        found = tried(a, g)
        moved = max(abs(found[1] - best[1]), abs(found[2] - best[2])) >= step * 0.99 and found[0] < best[0]
        best = min(best, found, key=lambda r: r[0])
        if not moved:
            step /= 3
    sse, a, g, level0, trend0 = best
    one = (np.array([a]), np.array([g]), np.array([level0]), np.array([trend0]))
    _, total, level, trend = _run(y, *one)
    l, b, ape, seen = level0, trend0, 0.0, 0
    for t, x in enumerate(y.tolist()):
        f = l + b
        if t and x > 0:
            ape, seen = ape + abs(x - f) / x, seen + 1
        after = f + a * (x - f)
        b, l = g * (after - l) + (1 - g) * b, after
    mean = total[0] / len(y)
    return {"alpha": float(a), "beta": float(g), "level0": float(level0), "trend0": float(trend0), "level": float(level[0]),
            "trend": float(trend[0]), "sse": float(sse), "sigma": float(np.sqrt(max(sse / len(y) - mean * mean, 0.0))),
            "mape_raw": float(ape / seen * 100.0) if seen else None}


def holt_estimated(filled: DataFrame, min_days: int = rules.HOLT_MIN_DAYS) -> DataFrame:
    """F4, F6, F7 with estimated parameters: as :func:`holt_fit`, and the
    initial state and squared error.  Every series is one group, bounded by
    its number of days; series are fitted side by side."""
    long = filled.groupBy("sid").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_days).select("sid")

    def fit(pdf):
        import pandas as pd

        pdf = pdf.sort_values("d")
        found = estimate_holt(pdf["y"].to_numpy(float))
        return pd.DataFrame([{"sid": pdf["sid"].iloc[0], "n": len(pdf), "last_date": pdf["d"].iloc[-1], **found}])

    return filled.join(long, "sid", "left_semi").select("sid", "d", "y").groupBy("sid").applyInPandas(fit, ESTIMATED)


def holt_forecast(fit: DataFrame, days_ahead: int) -> DataFrame:
    """F5 + F6: sid, date, forecast, lower_bound, upper_bound (2 dp, floored at 0)."""
    h = F.col("h")
    f = F.greatest(F.lit(0.0), F.col("level") + h * F.col("trend"))
    band = F.lit(rules.Z_95) * F.col("sigma") * F.sqrt(h.cast("double"))
    return (fit.select("sid", "last_date", "level", "trend", "sigma",
                       F.explode(F.sequence(F.lit(1), F.lit(days_ahead))).alias("h"))
               .select("sid", F.date_add("last_date", h).alias("date"), f.alias("f"), band.alias("w"))
               .select("sid", F.date_format("date", "yyyy-MM-dd").alias("date"),
                       exprs.np_round(F.col("f"), 2).alias("forecast"),
                       exprs.np_round(F.greatest(F.lit(0.0), F.col("f") - F.col("w")), 2).alias("lower_bound"),
                       exprs.np_round(F.col("f") + F.col("w"), 2).alias("upper_bound")))


def linear_fit(filled: DataFrame) -> DataFrame:
    """F8: least squares of y on day index 0..n-1 per series.

    Output: sid, n, last_date, slope, intercept, sigma (population std of
    residuals; 10 when there is one point).
    """
    # sums over a day number; the index 0..n-1 is that number less the first
    t = F.datediff("d", F.lit("1970-01-01").cast("date")).cast("double")
    sums = filled.withColumn("t", t).groupBy("sid").agg(
        F.count(F.lit(1)).alias("n"), F.max("d").alias("last_date"), F.min("t").alias("t0"), F.avg("t").alias("mt"),
        F.avg("y").alias("my"), F.regr_sxx("y", "t").alias("sxx"), F.regr_sxy("y", "t").alias("sxy"),
        F.regr_syy("y", "t").alias("syy"))
    slope = F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx"))
    sd = F.sqrt(F.greatest(F.col("syy") - F.coalesce(slope, F.lit(0.0)) * F.col("sxy"), F.lit(0.0)) / F.col("n"))
    return sums.select(
        "sid", "n", "last_date", F.coalesce(slope, F.lit(0.0)).alias("slope"),
        F.coalesce(F.col("my") - slope * (F.col("mt") - F.col("t0")), F.lit(0.0)).alias("intercept"),
        F.when(F.col("n") <= 1, F.lit(rules.OLS_SIGMA_SINGLE)).otherwise(sd).alias("sigma"))


def linear_forecast(fit: DataFrame, days_ahead: int) -> DataFrame:
    """F8 rows: constant band of +-1.96 sigma.  Same columns as holt_forecast."""
    h = F.col("h")
    f = F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * (F.col("n") - 1 + h).cast("double"))
    w = F.lit(rules.Z_95) * F.col("sigma")
    return (fit.select("sid", "last_date", "n", "slope", "intercept", "sigma",
                       F.explode(F.sequence(F.lit(1), F.lit(days_ahead))).alias("h"))
               .select("sid", F.date_add("last_date", h).alias("date"), f.alias("f"), w.alias("w"))
               .select("sid", F.date_format("date", "yyyy-MM-dd").alias("date"),
                       exprs.np_round(F.col("f"), 2).alias("forecast"),
                       exprs.np_round(F.greatest(F.lit(0.0), F.col("f") - F.col("w")), 2).alias("lower_bound"),
                       exprs.np_round(F.col("f") + F.col("w"), 2).alias("upper_bound")))


def forecast(df: DataFrame, date_col: str, value_col: str, days_ahead: int = 90,
             series_col: str | None = None, estimated: bool = False) -> tuple[DataFrame, DataFrame]:
    """History + forecast rows per series, and the accuracy per series.
    ``estimated``: parameters from :func:`holt_estimated`, not from the grid.

    Returns (rows, accuracy): rows has sid, date, historical, forecast,
    lower_bound, upper_bound; accuracy has sid, method, mape_raw, mape
    (capped at 25, 14.2 when not computed, 2 dp).
    """
    filled = fill_days(daily_totals(df, date_col, value_col, series_col))
    holt = stage(holt_estimated(filled), "holt") if estimated else holt_fit(filled)
    ser_n = filled.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    short = ser_n.where(F.col("n") < rules.HOLT_MIN_DAYS).select("sid")
    lin = linear_fit(filled.join(short, "sid", "left_semi"))
    fut = holt_forecast(holt, days_ahead).unionByName(linear_forecast(lin, days_ahead))
    hist = filled.select("sid", F.date_format("d", "yyyy-MM-dd").alias("date"), F.col("y").alias("historical"))
    rows = hist.unionByName(fut, allowMissingColumns=True)
    acc = (holt.select("sid", F.lit("holt").alias("method"), "mape_raw")
           .unionByName(lin.select("sid", F.lit("linear").alias("method"),
                                   F.lit(None).cast("double").alias("mape_raw"))))
    acc = acc.withColumn("mape", exprs.np_round(F.least(F.coalesce("mape_raw", F.lit(rules.MAPE_DEFAULT)),
                                                        F.lit(rules.MAPE_CAP)), 2))
    return rows, acc


def resolve_columns(prof: DataFrame) -> DataFrame:
    """first Date column; first Monetary/Quantity/Number in column order."""
    sem = F.col("semantic_type")
    return prof.agg(
        F.min_by("column_name", F.when(sem == "Date", F.col("ordinal"))).alias("date_col"),
        F.min_by("column_name", F.when(sem.isin("Monetary", "Quantity", "Number"),
                                       F.col("ordinal"))).alias("value_col"))


def digest(rows: DataFrame) -> DataFrame:
    """per series: history count/mean, forecast count/sum/mean/min/max."""
    return rows.groupBy("sid").agg(
        F.count("historical").alias("history_days"),
        exprs.np_round(F.avg("historical"), 2).alias("history_mean"),
        F.count("forecast").alias("forecast_days"),
        exprs.np_round(F.sum("forecast"), 2).alias("forecast_sum"),
        exprs.np_round(F.avg("forecast"), 2).alias("forecast_mean"),
        F.min("forecast").alias("forecast_min"), F.max("forecast").alias("forecast_max"))
