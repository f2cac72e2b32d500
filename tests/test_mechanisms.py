"""Estimated forecasts, relationship discovery, record index, batched K-Means,
incremental profiles and split CSV records."""

import csv
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import dashboard, forecast, metrics, profile, profile_state, record_index, segment
from ledgerlens.sources import catalog, upload


# ---------------------------------------------------------------- F4
def run_holt(y, a, g, level, trend):
    sse = 0.0
    for x in y:
        f = level + trend
        sse += (x - f) ** 2
        after = f + a * (x - f)
        trend, level = g * (after - level) + (1 - g) * trend, after
    return sse


def series(seed, n):
    rnd = np.random.default_rng(seed)
    return np.cumsum(rnd.normal(1, 4, n)) + 50 + rnd.normal(0, 8, n)


@pytest.mark.parametrize("seed,n", [(1, 14), (2, 40), (3, 90), (4, 30)])
def test_holt_estimate_against_a_dense_search(seed, n):
    y = series(seed, n) if seed < 4 else np.array([0.0, 5.0] * (n // 2))
    est = forecast.estimate_holt(y)
    assert run_holt(y, est["alpha"], est["beta"], est["level0"], est["trend0"]) == pytest.approx(est["sse"], rel=1e-9)
    steps = np.arange(1, 20) / 20
    grid = min(run_holt(y, a, g, y[0], y[1] - y[0]) for a in steps for g in steps)
    assert est["sse"] <= grid * (1 + 1e-12)
    # reference optimum: a dense grid, the initial state by least squares on the recursion itself
    fine = np.linspace(forecast.HOLT_LEAST, forecast.HOLT_MOST, 60)
    best = np.inf
    for a in fine:
        for g in fine:
            e = [np.array(_errors(y, a, g, *s)) for s in ((0, 0), (1, 0), (0, 1))]
            m = np.stack([e[0] - e[1], e[0] - e[2]], axis=1)
            state, *_ = np.linalg.lstsq(m, e[0], rcond=None)
            best = min(best, float(((e[0] - m @ state) ** 2).sum()))
    assert est["sse"] <= best * 1.01


def _errors(y, a, g, level, trend):
    out = []
    for x in y:
        f = level + trend
        out.append(x - f)
        after = f + a * (x - f)
        trend, level = g * (after - level) + (1 - g) * trend, after
    return out


def test_holt_estimated_many_series(spark):
    rows = [(f"s{k}", f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}", float(v)) for k in range(6) for i, v in enumerate(series(k, 30 if k else 10))]
    df = spark.createDataFrame(rows, "sid string, day string, v double").withColumn("day", F.to_date("day"))
    filled = forecast.fill_days(forecast.daily_totals(df, "day", "v", "sid"))
    est = {r["sid"]: r for r in forecast.holt_estimated(filled).collect()}
    grid = {r["sid"]: r for r in forecast.holt_fit(filled).collect()}
    assert set(est) == set(grid) == {f"s{k}" for k in range(1, 6)}
    for k, r in est.items():
        assert r["sse"] <= grid[k]["sse"] * (1 + 1e-9) and (r["n"], r["last_date"]) == (grid[k]["n"], grid[k]["last_date"])
    out, acc = forecast.forecast(df, "day", "v", 5, "sid", estimated=True)
    assert out.where("sid = 's1' AND forecast IS NOT NULL").count() == 5
    assert {r["sid"]: r["method"] for r in acc.collect()}["s0"] == "linear"


# ---------------------------------------------------------------- D7
def test_relationships_without_names(spark):
    rnd = random.Random(1)
    customers = spark.createDataFrame([(i * 7, f"c{i}") for i in range(3000)], "a long, b string")
    sales = spark.createDataFrame([(k, rnd.randrange(3000) * 7, f"c{rnd.randrange(3000)}", rnd.randrange(10 ** 9)) for k in range(9000)],
                                  "p long, q long, r string, s long")
    few = spark.createDataFrame([(7, "c1"), (14, None), (14, "zz")], "x int, y string")
    none = spark.createDataFrame([], "x int, y string")
    got = metrics.discover_relationships({"customers": customers, "sales": sales, "few": few, "none": none}, size=256)
    found = {(r["child_table"], r["child_column"], r["parent_table"], r["parent_column"]): r for r in got.collect()}
    assert set(found) == {("sales", "q", "customers", "a"), ("sales", "r", "customers", "b"), ("few", "x", "customers", "a"),
                          ("few", "x", "sales", "p")}
    q = sales.select("q").distinct().count()
    r = found["sales", "q", "customers", "a"]
    assert (r["child_values"], r["matched_values"], r["containment"], r["coverage"]) == (q, q, 1.0, q / 3000)


def test_sketches_merge_and_never_rule_out_what_holds(spark):
    df = spark.createDataFrame([(i,) for i in range(20000)], "v long")
    sub = df.where("v % 3 = 0")
    s = metrics.column_sketches({"all": df, "sub": sub}, size=200)
    a, b = s["sub", "v"], s["all", "v"]
    assert metrics.may_contain(a, b, 0.95) and not metrics.may_contain(b, a, 0.95)
    limit = metrics._below(min(a["theta"], b["theta"]))
    assert {h for h in a["hashes"] if h <= limit} <= b["hashes"]
    halves = metrics.column_sketches({"x": df.where("v < 9000"), "y": df.where("v >= 9000")}, size=200)
    theta = min(h["theta"] for h in halves.values())
    both = {h for k in halves.values() for h in k["hashes"] if h <= metrics._below(theta)}
    assert both == {r[0] for r in df.select(F.xxhash64("v")).collect() if r[0] <= metrics._below(theta)}


# ---------------------------------------------------------------- A8-A10
def records(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(500), rnd.choice(["Red Ring", "blue\\bar", None, "100% cotton", "İstanbul ring"]) if i % 7 else f"odd{i}",
             rnd.choice([1.5, float("nan"), None, 2e8, 300.25]), i % 2 == 0) for i in range(2000)]
    return spark.createDataFrame(rows, "k int, `a name` string, v double, flag boolean")


def test_record_index_pages(spark, tmp_path):
    df = records(spark)
    order = ["k", "a name", "v", "flag"]
    index = record_index.build(df, order, str(tmp_path / "i"), range_rows=150, search=False)
    whole = [str(tuple(r)) for r in dashboard.page(df, [F.col(f"`{c}`").asc_nulls_first() for c in order], 2000, 0).collect()]
    for offset, limit in ((0, 50), (140, 30), (1985, 50), (3000, 10), (777, 400)):
        page = index.page(limit, offset)
        assert [str(tuple(r)) for r in page.collect()] == whole[offset:offset + limit]
    assert index.directory().count() > 5
    assert len(index.page(20, 1900).inputFiles()) <= 2 or "_range" in index.page(20, 1900)._jdf.queryExecution().toString()
    assert record_index.build(df.limit(0), order, str(tmp_path / "e")).page().collect() == []


@pytest.mark.parametrize("term", ["ring", "RED r", "odd13", "0% co", "d_13", "e%ar", "\\bar", "ri", "300.2", "20000000", "true", "zzz", "i̇stan", None])
def test_record_index_search(spark, tmp_path, term):
    df = records(spark)
    index = record_index.build(df, ["k", "a name"], str(tmp_path / "i"), range_rows=150)
    assert sorted(map(str, index.search(term).collect())) == sorted(map(str, dashboard.search_records(df, term).collect()))
    assert index.match_count(term).collect() == dashboard.match_count(df, term).collect()


def test_record_index_opens_few_ranges(spark, tmp_path):
    df = spark.range(3000).select("id", F.concat(F.lit("name "), F.col("id")).alias("n"))
    index = record_index.build(df, ["id"], str(tmp_path / "i"), range_rows=300)
    assert len(index.candidate_ranges("name 2999")) == 1 and index.candidate_ranges("na") is None
    assert index.search("name 2999").count() == 1


# ---------------------------------------------------------------- M5
def test_batched_kmeans(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rnd = np.random.default_rng(2)
    pts = np.concatenate([rnd.normal(c, 0.4, (150, 3)) for c in ((0, 0, 0), (4, 0, 1), (0, 5, 2), (3, 3, 6))])
    df = spark.createDataFrame([tuple(map(float, p)) for p in pts], "x double, y double, z double")
    centres, cost = segment.batched_kmeans(df, 4, 42, 10)
    near = ((pts[:, None] - centres[None]) ** 2).sum(axis=2)
    assert cost == pytest.approx(near.min(axis=1).sum())
    feats = VectorAssembler(inputCols=["x", "y", "z"], outputCol="features").transform(df)
    best = min(KMeans(k=4, seed=42 + i, maxIter=100).fit(feats).summary.trainingCost for i in range(3))
    assert cost <= best * (1 + 1e-3)
    got = [r["cluster"] for r in segment.assign_clusters(df, centres, ["x", "y", "z"]).collect()]
    assert got == near.argmin(axis=1).tolist()
    same = spark.createDataFrame([(1.0, 1.0)] * 7, "x double, y double")
    assert segment.batched_kmeans(same, 4, 1, 3)[1] == 0.0
    assert segment.batched_kmeans(same.limit(0), 4, 1, 3)[1] == 0.0


# ---------------------------------------------------------------- P1-P7 by states
def test_merged_states_equal_a_profile(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([None, 1.25, float("nan"), -7.5, 1e6 + i]), rnd.choice(["$1,200.50", "3", None]), f"n{i % 300}", i % 3 == 0)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v double, price string, name string, flag boolean").withColumn(
        "t", F.timestamp_seconds(F.col("id") * 86400))
    parts = [profile_state.column_states(df.where(F.pmod("id", F.lit(4)) == k)) for k in range(4)]
    got = {r["column_name"]: r for r in profile_state.profile_of_state(profile_state.merge_states(*parts)).collect()}
    for r in profile.profile(df).collect():
        g = got[r["column_name"]]
        for c in ("ordinal", "data_type", "semantic_type", "null_percentage", "min_value", "max_value"):
            assert g[c] == r[c], (r["column_name"], c)
        for c in ("mean_value", "std_dev_value"):
            assert (g[c] is None and r[c] is None) or g[c] == pytest.approx(r[c], rel=1e-9)
        assert abs(g["distinct_count"] - r["distinct_count"]) <= 0.03 * r["distinct_count"] + 1
    values = sorted(range(3000))
    assert abs(values.index(int(got["id"]["median_value"])) - 1500) <= 30
    empty = profile_state.profile_of_state(profile_state.column_states(df.limit(0))).collect()
    assert [r["distinct_count"] for r in empty] == [0] * 6 and empty[1]["mean_value"] is None


def test_appended_rows_are_profiled_alone(spark, tmp_path):
    root = str(tmp_path)
    for k in range(3):
        catalog.append_rows(spark.range(k * 100, k * 100 + 100).withColumn("x", F.col("id") * 0.5), root, "d")
    assert catalog.read_parts(spark, root, "d").count() == 300
    prof = {r["column_name"]: r for r in catalog.stored_metadata(spark, root, "column_metadata", "d", "cleaned").collect()}
    assert (prof["id"]["min_value"], prof["id"]["max_value"], prof["x"]["mean_value"]) == ("0", "299", pytest.approx(74.75))


# ---------------------------------------------------------------- S1
@pytest.mark.parametrize("quoting,end,stray", [(csv.QUOTE_ALL, "\n", False), (csv.QUOTE_MINIMAL, "\r\n", False), (csv.QUOTE_MINIMAL, "\n", True)])
def test_csv_records_by_split(spark, tmp_path, quoting, end, stray):
    rnd = random.Random(1)
    values = ["x", 'say "hi"', "two\nlines", "a,b", "", "\n", '"', "l1\nl2\n\nl3", 'q"\n"q', "long " * 30 + "\n", "id"]
    p = tmp_path / "u.csv"
    with open(p, "w", newline="") as f:
        w = csv.writer(f, quoting=quoting, lineterminator=end)
        w.writerow(["id", "a b", "c\nd"])
        w.writerows([[str(i), rnd.choice(values), rnd.choice(values)] for i in range(300)])
        w.writerow(["id", "a b", "c\nd"])  # a row like the header is a row
        if stray:
            f.write('900,5" pipe,7\n901,x "y" z,"v"\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(str(p)).rdd.getNumPartitions() > 3
        got = upload.read_upload_csv(spark, str(p))
        whole = upload.read_upload_csv(spark, str(p), multi_line=True)
        assert got.columns == whole.columns
        if end == "\n":
            want = sorted(str(tuple(r)) for r in whole.collect())
        else:  # Spark's whole-file reader leaves carriage returns in last values
            with open(p, newline="") as f:
                want = sorted(str(tuple(v or None for v in r)) for r in list(csv.reader(f))[1:])
        assert sorted(str(tuple(r)) for r in got.collect()) == want and got.count() == 303 - 2 * (not stray)
        assert upload.csv_records(spark, str(p)).where("first").count() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_record_over_many_splits(spark, tmp_path):
    p = tmp_path / "u.csv"
    p.write_text('a,b\n1,"' + "line of text\n" * 900 + '"\n2,"x\ny"\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {r["a"]: r["b"] for r in upload.read_upload_csv(spark, str(p)).collect()}
        assert got == {"1": "line of text\n" * 900, "2": "x\ny"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


# ---------------------------------------------------------------- small mends
def test_numbers_are_searched_only_for_what_they_can_hold(spark):
    df = spark.createDataFrame([(1.0e10, "x"), (float("nan"), "other"), (2.5e-7, "e")], "v double, t string")
    assert dashboard.search_records(df, "0000000000.").count() == 1
    assert dashboard.search_records(df, "nan").count() == 1
    assert dashboard.search_records(df, "2.5E-0").count() == dashboard.search_records(df, "2.5e-0").count()
    plan = dashboard.search_records(df, "ring")._jdf.queryExecution().toString()
    assert "ilike(cast(v" not in plan.lower() and "regexp" not in plan.lower()


def test_clean_computes_only_what_is_asked(spark):
    from ledgerlens.operators import clean

    df = spark.createDataFrame([("2024-01-02", "1"), (None, "2"), ("2024-03-04", None)], "d string, n string")
    res = clean.clean(df)
    assert {r["column_name"]: r["inferred_type"] for r in res.types.collect()} == {"d": "DateTime", "n": "Integer"}
    assert "data" not in res.__dict__ and "medians" not in res.__dict__
    assert res.report.first()["processed_records"] == 3 and "data" not in res.__dict__
    assert sorted(r["n"] for r in res.data.collect()) == [1.0, 1.5, 2.0]
