"""Exact quantiles with bounded memory (medians, quartiles).

Spark's exact ``percentile``/``median`` merge a map of every distinct value
of a column in one task; that does not survive a column with billions of
distinct values.  Exact selection instead narrows a value window around
each wanted rank.  A round takes two one-row aggregates for all open windows:

1. sketched quantiles just below and just above the rank (mergeable, of
   fixed size) propose a narrower window.  They split by value order, so
   neither outliers nor the range of doubles matter;
2. exact counts place the rank below, at the lower end, inside, at the upper
   end of, or above the proposal.  A rank on an end is answered; otherwise
   the window shrinks to the open part that holds it, so every round makes
   progress whatever the sketch said.

A window of at most ``finish`` rows is sorted by the executors' partial
counts, and at most that many (value, count) pairs are read.  A column known to
have at most ``finish`` different values takes no rounds: its counts by value say
every rank.  Interpolation
is linear between the two neighbouring ranks, computed as numpy does.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import exprs

FINISH = 1024
ACCURACY = 10_000


def _lerp(a: float, b: float, t: float) -> float:
    d = b - a
    if math.isinf(d):  # the ends lie further apart than a double can say
        return a * (1.0 - t) + b * t
    return b - d * (1.0 - t) if t >= 0.5 else a + d * t


def exact_quantiles(df: DataFrame, columns: dict[str, Column], probs: list[float], finish: int = FINISH,
                    accuracy: int = ACCURACY, distinct: dict[str, int] | None = None) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of each column expression; null
    and NaN take no part.  ``distinct``: how many different values some of the
    columns have at most, if that is known."""
    names = list(columns)
    if not names:
        return {}
    base = df.select(*[F.nanvl(e.cast("double"), F.lit(None).cast("double")).alias(f"_x{i}")
                       for i, e in enumerate(columns.values())])
    few = [i for i, n in enumerate(names) if (distinct or {}).get(n, finish + 1) <= finish]
    return _select(base, names, probs, finish, accuracy, few)


def _select(base: DataFrame, names: list[str], probs: list[float], finish: int, accuracy: int, few: Sequence[int] = ()):
    D = exprs.sql_double  # plans are built as SQL text: one JVM call per expression
    r0 = base.selectExpr(*[a for i in range(len(names)) for a in (
        f"count(_x{i}) AS n{i}", f"min(_x{i}) AS lo{i}", f"max(_x{i}) AS hi{i}")]).first()
    plan: dict[int, list[tuple[int, int, float]]] = {i: [] for i in range(len(names))}
    targets: dict[tuple[int, int], dict] = {}  # (column, rank) -> window [lo, hi], rows below it, rows in it
    for i in range(len(names)):
        n = r0[f"n{i}"]
        for p in probs if n else []:
            h = p * (n - 1)
            low = int(math.floor(h))
            high = min(low + 1, n - 1)
            plan[i].append((low, high, h - low))
            for r in (low, high):
                targets.setdefault((i, r), {"lo": r0[f"lo{i}"], "hi": r0[f"hi{i}"], "below": 0, "size": n})
    values: dict[tuple[int, int], float] = {}
    few = [i for i in few if any(k[0] == i for k in targets)]
    if few:
        # a branch scans one column; at most `finish` rows each
        counted = reduce(DataFrame.unionAll, [
            base.where(f"_x{i} IS NOT NULL").groupBy(f"_x{i}").agg(F.count(F.lit(1)).alias("c"))
                .selectExpr(f"{i} AS i", f"_x{i} AS v", "c") for i in few])
        tally: dict[int, list] = {}
        for row in counted.collect():
            tally.setdefault(row["i"], []).append((row["v"], row["c"]))
        values = {k: _ranked(tally[k[0]], k[1]) for k in targets if k[0] in few}
    while True:
        for k, t in targets.items():
            if k not in values and t["lo"] == t["hi"]:
                values[k] = t["lo"]
        open_ = [k for k, t in targets.items() if k not in values and t["size"] > finish]
        if not open_:
            break
        _narrow(base, targets, values, open_, accuracy, D)
    rest = [k for k in targets if k not in values]
    if rest:
        sel = ", ".join(f"CASE WHEN _x{k[0]} >= {D(targets[k]['lo'])} AND _x{k[0]} <= {D(targets[k]['hi'])} "
                        f"THEN named_struct('t', {j}, 'v', _x{k[0]}) END" for j, k in enumerate(rest))
        pairs = (base.selectExpr(f"explode(filter(array({sel}), p -> p IS NOT NULL)) AS p")
                     .selectExpr("p.t AS t", "p.v AS v").groupBy("t", "v").agg(F.count(F.lit(1)).alias("c")))
        per: dict[int, list] = {}
        for row in pairs.collect():  # at most `finish` rows a target
            per.setdefault(row["t"], []).append((row["v"], row["c"]))
        for j, k in enumerate(rest):
            values[k] = _ranked(per[j], k[1] - targets[k]["below"])
    return {name: [_lerp(values[i, a], values[i, b], t) for a, b, t in plan[i]] or [None] * len(probs)
            for i, name in enumerate(names)}


def _ranked(pairs: list[tuple[float, int]], rank: int) -> float:
    """The value at a rank (from 0) of (value, count) pairs."""
    for v, c in sorted(pairs):
        rank -= c
        if rank < 0:
            return v
    raise ValueError("rank beyond the counted rows")


def _narrow(base, targets, values, open_, accuracy, D) -> None:
    """One round for the open targets: a sketch of every window, then counts.

    Targets of one window share its sketch; neighbouring ranks (the two that an
    even median lies between) also share a proposal and its counts."""
    windows: dict[tuple, list[list]] = {}
    for k in sorted(open_):
        t = targets[k]
        runs = windows.setdefault((k[0], t["lo"], t["hi"], t["below"]), [])
        if runs and k[1] - runs[-1][-1][1] <= 1:
            runs[-1].append(k)
        else:
            runs.append([k])
    sketches, proposed = [], []  # proposed: its ranks, the window's test, sketch and place in it
    for g, ((i, lo, hi, below), runs) in enumerate(windows.items()):
        inside = f"_x{i} >= {D(lo)} AND _x{i} <= {D(hi)}"
        at = []
        for r in runs:
            size = targets[r[0]]["size"]
            slack = size * 2.0 / accuracy + 1
            proposed.append((r, inside, f"p{g}", len(at)))
            at += [min(1.0, max(0.0, (rank - below + d) / size)) for rank, d in ((r[0][1], -slack), (r[-1][1], slack))]
        sketches.append(f"percentile_approx(CASE WHEN {inside} THEN _x{i} END, "
                        f"array({', '.join(f'{p!r}D' for p in at)}), {accuracy}) AS p{g}")
    guess = base.selectExpr(*sketches).first()
    ends = [guess[p][k:k + 2] for _, _, p, k in proposed]
    counts = []  # a small aggregate a proposal, each over its own column, in one job
    for j, (r, w, _, _) in enumerate(proposed):
        x, a, b = f"_x{r[0][0]}", D(ends[j][0]), D(ends[j][1])
        counts.append(base.selectExpr(
            f"count_if({w} AND {x} < {a}) AS b", f"count_if({x} = {a}) AS a",
            f"count_if({x} > {a} AND {x} < {b}) AS m", f"count_if({x} = {b}) AS e",
            f"max(CASE WHEN {w} AND {x} < {a} THEN {x} END) AS bx",
            f"min(CASE WHEN {x} > {a} AND {x} < {b} THEN {x} END) AS mn",
            f"max(CASE WHEN {x} > {a} AND {x} < {b} THEN {x} END) AS mx",
            f"min(CASE WHEN {w} AND {x} > {b} THEN {x} END) AS en").selectExpr(f"{j} AS j", "*"))
    got = {r["j"]: r for r in reduce(DataFrame.unionAll, counts).collect()}  # one row a proposal
    for j, k in ((j, k) for j, (r, _, _, _) in enumerate(proposed) for k in r):
        t, (a, b) = targets[k], ends[j]
        want = k[1] - t["below"]
        below, at, middle = got[j]["b"], got[j]["a"], got[j]["m"]
        end = got[j]["e"] if b > a else 0
        if want < below:
            t.update(hi=got[j]["bx"], size=below)
        elif want < below + at:
            values[k] = a
        elif want < below + at + middle:
            t.update(lo=got[j]["mn"], hi=got[j]["mx"], below=t["below"] + below + at, size=middle)
        elif want < below + at + middle + end:
            values[k] = b
        else:
            past = below + at + middle + end
            t.update(lo=got[j]["en"], below=t["below"] + past, size=t["size"] - past)
