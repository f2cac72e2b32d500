"""The skew-safe operators against brute force, with hot keys spread over
many partitions (so the cross-partition carries are exercised)."""

import random

import pandas as pd
from pyspark.sql import functions as F

from ledgerlens.operators import clean as C
from ledgerlens.operators import conversations as T


def test_fill_dates_matches_pandas(spark):
    rnd = random.Random(7)
    n = 3000
    vals = [None if rnd.random() < 0.6 else rnd.randint(0, 10_000) for _ in range(n)]
    vals[:50] = [None] * 50
    vals[-70:] = [None] * 70
    pdf = pd.DataFrame({"pos": list(range(n)), "d": [None if v is None else pd.Timestamp("2020-01-01") +
                                                     pd.Timedelta(days=v) for v in vals]})
    df = spark.createDataFrame(pdf[["pos"]].assign(d=pdf["d"].astype("object"))).repartition(13)
    out = C.fill_dates(df, ["d"], "pos").orderBy("pos").toPandas()
    expect = pdf["d"].ffill().bfill()
    assert (pd.to_datetime(out["d"]).values == pd.to_datetime(expect).values).all()


def test_merge_turns_hot_conversation(spark):
    rnd = random.Random(3)
    rows = []
    for conv, n in [(1, 4000), (2, 5), (3, 1)]:  # conversation 1 holds almost all rows
        role = "user"
        for t in range(n):
            if rnd.random() < 0.3:
                role = "assistant" if role == "user" else "user"
            rows.append((conv, t, role, f"m{conv}-{t}"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(11)
    got = sorted((r["conv_id"], r["first_turn"], r["last_turn"], r["role"], r["text"])
                 for r in T.merge_turns(df).collect())
    expect = []
    for conv in (1, 2, 3):
        cur = None
        for c, t, role, text in [r for r in rows if r[0] == conv]:
            if cur and cur[3] == role:
                cur = (c, cur[1], t, role, cur[4] + "\n" + text)
            else:
                if cur:
                    expect.append(cur)
                cur = (c, t, t, role, text)
        expect.append(cur)
    assert got == sorted(expect)


def test_top_k_hot_group(spark):
    rows = [(1, t) for t in range(5000)] + [(2, t) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long")
    top = T.top_k_per_group(df, ["conv_id"], [F.col("turn").desc()], 8, salt_on="turn", salts=16)
    got = sorted((r["conv_id"], r["turn"]) for r in top.collect())
    assert got == sorted([(1, t) for t in range(4992, 5000)] + [(2, t) for t in range(3)])


def test_band_join_matches_brute_force(spark):
    rnd = random.Random(11)
    turns = []
    for conv in range(20):
        ctx_nums = [round(rnd.uniform(11, 500), 2) for _ in range(30)]
        turns.append((conv, 0, "system", " ".join(f"v{x}" if False else f"{x}" for x in ctx_nums)))
        for t in range(1, 6):
            nums = [round(x + rnd.choice([0, 0.03, -0.04, 0.06, 1.0]), 2) for x in rnd.sample(ctx_nums, 3)]
            turns.append((conv, t, "assistant", " and ".join(str(x) for x in nums)))
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["grounded"] for r in
           T.grounding_check(df.where("role = 'assistant'"), T.conversation_context(df)).collect()}
    import re
    for conv, t, role, text in turns:
        if role != "assistant":
            continue
        ctx = set()
        for c2, t2, _, x2 in turns:
            if c2 == conv and t2 < t:
                ctx |= {float(m) for m in re.findall(r"\b\d+(?:\.\d+)?\b", x2.replace(",", ""))}
        ok = all(v in {0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 30, 60, 90, 100} or any(abs(v - c) < 0.05 for c in ctx)
                 for v in {float(m) for m in re.findall(r"\b\d+(?:\.\d+)?\b", text.replace(",", ""))})
        assert got[(conv, t)] == ok


def test_modes_ties_and_hot_value(spark):
    rows = [("b",)] * 5000 + [("a",)] * 5000 + [("c",)] * 10
    df = spark.createDataFrame(rows, "x string").repartition(9)
    assert C.modes(df, {"x": F.col("x")}) == {"x": "a"}


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    from ledgerlens.operators.quantiles import exact_quantiles
    rnd = np.random.default_rng(5)
    a = np.concatenate([rnd.normal(size=3000), np.full(2500, 1.25), rnd.integers(0, 20, 700).astype(float)])
    b = rnd.exponential(size=a.size)
    b[::7] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b})).repartition(7)
    df = df.withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    probs = [0.25, 0.5, 0.75]
    got = exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, probs, finish=40, accuracy=50)
    assert got["a"] == list(np.quantile(a, probs))
    assert got["b"] == list(np.quantile(b[~np.isnan(b)], probs))


def test_value_tallies(spark):
    from ledgerlens.operators.profile import value_tallies

    rows = [("1", 0.0), ("$2,000.5", -0.0), ("x", 1.5), (None, None), ("1", 1.5), ("", float("inf"))]
    df = spark.createDataFrame(rows * 3, "`a b` string, d double")
    got = value_tallies(df, {0: "`a b`", 4: "d"})
    assert got[0] == {"k": 0, "n": 4, "numbers": 9, "lo": "", "hi": "x"}
    assert got[4]["n"] == 4  # both zeros, as in their texts
    empty = value_tallies(df.where("d > 9e300 AND d < 0"), {0: "`a b`", 1: "d"})
    assert [(r["n"], r["numbers"], r["lo"]) for r in empty.values()] == [(0, 0, None)] * 2


def test_lines_are_not_dealt_by_customer(spark):
    """Orders meet customer below the join with the lines, whatever the columns."""
    from ledgerlens.plans.star import sales_lines

    class T:
        pass

    t = T()
    for name, cols in {"lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                       "l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
                       "orders": "o_orderkey long, o_custkey long, o_orderdate timestamp",
                       "customer": "c_custkey long, c_name string, c_nationkey int, c_mktsegment string",
                       "part": "p_partkey long, p_type string, p_name string, p_brand string", "supplier": "s_suppkey long, s_name string",
                       "nation": "n_nationkey int, n_name string, n_regionkey int", "region": "r_regionkey int, r_name string"}.items():
        setattr(t, name, spark.createDataFrame([], cols))
    plan = sales_lines(t)._jdf.queryExecution().analyzed().toString().splitlines()
    depth = {k: next(i for i, line in enumerate(plan) if "Join" in line and k in line) for k in ("c_custkey", "l_orderkey", "l_partkey")}
    assert depth["l_orderkey"] < depth["l_partkey"] and depth["l_orderkey"] < depth["c_custkey"]
    indent = lambda k: len(plan[depth[k]]) - len(plan[depth[k]].lstrip(" :+-|"))
    assert indent("c_custkey") > indent("l_orderkey")


def test_column_metadata_reads_its_input_once(spark):
    """One pass: the input may be a join of large tables."""
    from ledgerlens.operators.profile import column_metadata

    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for p in parts:
            seen.add(p.num_rows)
            yield p

    df = spark.createDataFrame([(str(i), "$1" if i % 10 else "no", i % 3, "AB"[i % 2]) for i in range(100)],
                               "product string, worth string, status int, kind string")
    got = {r["column_name"]: (r["data_type"], r["semantic_type"]) for r in column_metadata(df.mapInArrow(count, df.schema)).collect()}
    assert got == {"product": ("Float", "Number"), "worth": ("Float", "Boolean"), "status": ("Integer", "Boolean"),
                   "kind": ("Text", "Boolean")}
    assert seen.value == 100


def test_columns_of_few_values_take_no_sketch(spark, monkeypatch):
    """A profile's medians of columns with few values come from their counts."""
    import numpy as np
    from ledgerlens.operators import quantiles
    from ledgerlens.operators.profile import profile

    narrowed = []
    narrow = quantiles._narrow
    monkeypatch.setattr(quantiles, "_narrow", lambda b, t, v, open_, *a: (narrowed.append({k[0] for k in open_}), narrow(b, t, v, open_, *a)))
    df = spark.sql("""SELECT id AS many, CAST(id % 7 * id % 5 AS INT) AS few, if(id % 3 = 0, NULL, id % 4 - 1.5D) AS holes,
        CAST(NULL AS DOUBLE) AS none, '$' || id % 6 AS money FROM range(3000)""")
    got = {r["column_name"]: r["median_value"] for r in profile(df).collect()}
    ids = range(3000)
    assert got == {"many": 1499.5, "few": np.median([i % 7 * i % 5 for i in ids]), "none": None,
                   "holes": np.median([i % 4 - 1.5 for i in ids if i % 3]), "money": np.median([i % 6 for i in ids])}
    assert narrowed and set().union(*narrowed) == {0}  # a sketch of the first column alone


def test_metadata_of_joined_lines_carries_codes_only(spark, monkeypatch):
    """No value crosses a join of the metadata's input, and codes decide as the
    values do: with nulls, repeated keys, texts of numbers and equal codes."""
    from ledgerlens.operators import profile
    from ledgerlens.plans.star import own_column, sales_lines

    class T:
        pass

    t = T()
    day = "timestamp'2020-01-01'"
    t.lineitem = spark.sql(f"""SELECT id % 40 AS l_orderkey, id % 8 AS l_partkey, if(id % 9 = 0, NULL, id % 3) AS l_suppkey, 7 AS l_linenumber,
        1D AS l_quantity, 2D AS l_extendedprice, 0D AS l_discount, 'RNA' AS l_returnflag, element_at(array('O', 'F'), CAST(id % 2 + 1 AS INT)) AS l_linestatus,
        {day} AS l_shipdate FROM range(200)""")
    t.orders = spark.sql(f"SELECT id AS o_orderkey, id % 6 AS o_custkey, {day} AS o_orderdate FROM range(40)")
    t.customer = spark.sql("SELECT id % 5 AS c_custkey, if(id = 1, NULL, '$' || id) AS c_name, 0 AS c_nationkey, 'M' || id % 2 AS c_mktsegment FROM range(7)")
    t.part = spark.sql("SELECT id AS p_partkey, 'T' || id AS p_type, 'n' || id % 2 AS p_name, if(id < 3, '1,000', 'x') AS p_brand FROM range(300)")
    t.supplier = spark.sql("SELECT id AS s_suppkey, CAST(NULL AS STRING) AS s_name FROM range(3)")
    t.nation = spark.sql("SELECT 0 AS n_nationkey, 'N' AS n_name, 0 AS n_regionkey")
    t.region = spark.sql("SELECT 0 AS r_regionkey, 'R' AS r_name")
    lines = sales_lines(t)
    want = [tuple(r) for r in profile.column_metadata(lines).collect()]
    assert {r[2] for r in want} == {"Integer", "Float", "Text", "DateTime"} and {"Boolean", "Text", "Number"} <= {r[3] for r in want}
    for codes in (profile.CODES, 1):  # one code: every column is counted by its values after all
        monkeypatch.setattr(profile, "CODES", codes)
        coded = sales_lines(t, reading=profile.value_codes)
        assert {f.dataType.simpleString() for f in coded.schema} == {"smallint"} and coded.count() == lines.count()
        assert [tuple(r) for r in profile.column_metadata(lines, coded, lambda c: own_column(t, c)).collect()] == want


def test_targets_of_a_window_share_a_sketch(spark):
    from ledgerlens.operators import quantiles

    df = spark.range(1000).selectExpr("CAST(id * 37 % 1000 AS DOUBLE) AS _x0")
    asked = []

    class Spy:
        def selectExpr(self, *e):
            asked.append(e)
            return df.selectExpr(*e)

    got = quantiles._select(Spy(), ["x"], [0.25, 0.5, 0.75], 10, 50)
    assert got == {"x": [249.75, 499.5, 749.25]}
    first = next(e for e in asked if "percentile_approx" in e[0])
    assert len(first) == 1  # four before: one a rank


def test_null_report_parses_nothing(spark):
    from ledgerlens.operators import clean

    df = spark.createDataFrame([("1", None), ("1", None), (None, "2020-01-02"), ("x", "nan")], "a string, b string")
    res = clean.clean(df)
    want = [("a", 33.33), ("b", 33.33)]
    assert [(r["column_name"], r["null_percentage"]) for r in res.null_report.orderBy("ordinal").collect()] == want
    assert "rows" not in res.__dict__  # nothing was parsed and written for it
    assert res.report.first()["duplicates_removed"] == 1
    again = clean.clean(df)
    again.info
    assert [(r["column_name"], r["null_percentage"]) for r in again.null_report.orderBy("ordinal").collect()] == want


def test_parsed_readings_of_many_columns(spark):
    """The rules stand in the plan once, however many text columns there are."""
    from ledgerlens.operators import clean

    vals = ["$1,234.5", " 7 ", "1e3", "1d", "0x1p3", "NaN", "", "-", "2020-01-02", " 03/04/2021 ", "Jan 5, 2020", "31/12/2020", "12-34", None]
    df = spark.createDataFrame([(v,) * 3 + (1.5,) for v in vals], "a string, b string, `c c` string, n double")
    cand = clean.parse_candidates(df, df.columns)
    want = df.select(*[e.alias(f"x{i}") for i, e in enumerate([clean.exprs.parse_number("a"), clean.parse_date("a")])]).collect()
    for i in range(3):
        assert cand.select(f"_p{i}", f"_d{i}").collect() == want
    plan = cand._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") + plan.count("rlike") <= 14 and "_p3" not in cand.columns


def test_upload_reads_the_lines_once(spark):
    from ledgerlens.plans import dirty

    class T:
        lineitem = spark.createDataFrame([(k, 1, 1, 1, 2.0, 0.1, "R", "O", None) for k in (50, 51, 100, None)], "l_orderkey long, l_partkey long, "
                                         "l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, "
                                         "l_linestatus string, l_shipdate timestamp")
        part = spark.createDataFrame([(1, "A", 9.5)], "p_partkey long, p_type string, p_retailprice double")

    up = dirty.upload_lines(T)
    assert sorted(str(r["order_number"]) for r in up.collect()) == ["100", "100", "50", "50", "51", "None"]
    assert up._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def _staged(spark, prefix):
    """Rows in each stage folder of a name."""
    import glob

    import pyarrow.dataset as ds
    from ledgerlens.session import shared_dir

    return {d: ds.dataset(d, format="parquet").count_rows()
            for d in glob.glob(shared_dir(spark, "stage").removeprefix("file:") + f"/{prefix}-*")}


def _shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in found.split("\n") if f.endswith(".data")}


def test_date_fill_moves_gaps_only(spark):
    """Rows that have their dates send the dates along, nothing else is written or shuffled."""
    n = 20_000
    df = spark.range(n).selectExpr(
        "struct(id % 3 AS a, id AS b) AS pos", "id", "CASE WHEN id % 50 != 0 THEN timestamp_seconds(id * 60) END AS d1",
        "CASE WHEN id % 3 != 1 OR id % 100 > 2 THEN timestamp(date_add(DATE'2020-01-01', CAST(id % 900 AS INT))) END AS e",
        "CAST(NULL AS timestamp) AS f", "CAST(id AS decimal(20, 3)) AS m", "repeat('w', 300) AS t").repartition(7)
    before = _staged(spark, "date")
    out = C.fill_dates(df, ["d1", "e"], "pos")
    new = [v for k, v in _staged(spark, "date").items() if k not in before]
    gaps = df.where("d1 IS NULL OR e IS NULL").count()
    assert gaps < n / 20 and sum(new) <= gaps + 7 * 8
    got = out.orderBy("pos").toPandas()
    want = df.orderBy("pos").toPandas()
    assert list(got.columns) == df.columns and len(got) == n
    for c in ("d1", "e"):
        want[c] = want[c].ffill().bfill()
    assert got["d1"][0] == want["d1"][0] and want["d1"].notna().all()
    pd.testing.assert_frame_equal(got.drop(columns="f"), want.drop(columns="f"))
    none = C.fill_dates(df.limit(100), ["f"], "pos", F.lit("2024-05-06 07:08:09").cast("timestamp"))
    assert [tuple(r) for r in none.groupBy(F.col("f").cast("string")).count().collect()] == [("2024-05-06 07:08:09", 100)]


def test_cleaning_leaves_little_on_the_disks(spark, monkeypatch):
    """A large upload is de-duplicated in rounds; shuffle files and the written upload go as soon as they are used."""
    import hashlib
    import os
    import time

    text = ["".join(hashlib.sha256(f"{k} {i}".encode()).hexdigest() for i in range(4)) for k in range(3000)]
    rows = [(str(k), None if k % 17 == 3 else f"2020-01-{k % 28 + 1:02d}", text[k] if k % 5 else None, f"${k},000.5")
            for k in range(3000)]
    rows += rows[::50] * 3 + [(None, None, None, None)] * 5
    df = spark.createDataFrame(rows, "k string, d string, t string, p string").repartition(6)
    spark.sparkContext._jvm.System.gc()
    monkeypatch.setattr(C, "ROUND_BYTES", 4096, raising=False)
    before, staged = _shuffle_files(spark), _staged(spark, "clean")
    res = C.clean(df, order_by=[F.col("k").cast("long")])
    data = res.data
    left = _shuffle_files(spark) - before
    new = {k: v for k, v in _staged(spark, "clean").items() if k not in staged}
    assert list(new.values()) == [3001] and "clean-candidates" in list(new)[0]
    # the written upload is gone, and so are the rows dealt by hash and by range
    size = lambda: sum(os.path.getsize(f) for f in left if os.path.exists(f))
    for _ in range(50):  # executors remove them soon after
        if size() >= 100_000:
            time.sleep(0.2)
    assert size() < 100_000
    got = sorted((r["k"], str(r["d"])[:10], r["t"], r["p"]) for r in data.collect())
    last, want, common = None, [], min(t for _, _, t, _ in rows if t)
    dates = {k: d for k, d, _, _ in rows if k}
    for k in range(3000):
        last = dates[str(k)] or last
        want.append((float(k), last, text[k] if k % 5 else common, k * 1000 + 0.5))
    # the row of nulls comes first: its date is the first one, its numbers are the medians
    want.append((1499.5, "2020-01-01", common, 1499500.5))
    assert got == sorted(want)
    r = res.report.first()
    assert (r["total_records"], r["processed_records"]) == (len(rows), 3001)
    # by position, as a CSV upload is: the copies' first place counts
    plain = C.clean(df.where("k IS NOT NULL")).data
    assert plain.count() == 3000 and plain.where("d IS NULL").isEmpty()
