"""Inputs beyond the oracle tables: many ranges, extremes, NaN, odd numbers,
dates and CSV dialect, against hand-written results or plain windows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from ledgerlens.functions import exprs
from ledgerlens.operators import clean as C
from ledgerlens.operators import conversations as T
from ledgerlens.operators import forecast as fc
from ledgerlens.operators import profile as prof
from ledgerlens.operators.quantiles import exact_quantiles
from ledgerlens.sources import upload


@pytest.fixture(params=["true", "false"])
def many_ranges(spark, request):
    """Many shuffle partitions, adaptive execution on and off."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.enabled": request.param}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_merge_turns_keeps_every_turn(spark, many_ranges):
    n = 300_000
    turns = spark.range(n).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 1000 END AS conv_id", "id AS turn",
        "CASE WHEN pmod(xxhash64(id), 5) < 2 THEN 'user' ELSE 'assistant' END AS role",
        "concat('turn ', id, repeat('x', 40)) AS text")
    got = T.merge_turns(turns)
    w = Window.partitionBy("conv_id").orderBy("turn")
    change = (F.lag("role").over(w).isNotNull() & (F.lag("role").over(w) != F.col("role"))).cast("int")
    plain = (turns.withColumn("c", change).withColumn("block", F.sum("c").over(w))
             .groupBy("conv_id", "block").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"),
                                              F.first("role").alias("role"), F.count("*").alias("n")))
    mine = got.select("conv_id", "block", "first_turn", "last_turn", "role",
                      F.size(F.split("text", "\n")).cast("long").alias("n"))
    total = mine.agg(F.sum("n")).first()[0]
    assert total == n
    assert mine.exceptAll(plain.select(mine.columns)).isEmpty() and mine.count() == plain.count()


def test_fill_dates_over_many_ranges(spark, many_ranges):
    df = spark.range(300_000).selectExpr(
        "id AS pos", "CASE WHEN pmod(xxhash64(id), 7000) = 1 THEN timestamp_seconds(id * 60) END AS d", "repeat('w', 30) AS t")
    out = C.fill_dates(df, ["d"], "pos")
    plain = df.select("pos", F.coalesce(F.last("d", True).over(Window.orderBy("pos")),
                                        F.last("d", True).over(Window.orderBy(F.desc("pos")))).alias("e"))
    assert out.join(plain, "pos").where(~F.col("d").eqNullSafe(F.col("e"))).isEmpty()


@pytest.mark.parametrize("values", [
    np.concatenate([np.random.default_rng(1).normal(size=20_000), [1.7e308, -1.7e308]]),
    np.repeat([1.0, 2.0], 9000), np.arange(30_000) * 1e-300, np.concatenate([np.zeros(9000), np.arange(9000.0)]),
], ids=["extremes", "two values", "tiny", "hot value"])
def test_quantiles_of_any_shape(spark, values, monkeypatch):
    df = spark.createDataFrame(pd.DataFrame({"x": values})).repartition(5)
    read = []
    frame = type(df)
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: read.append(collect(self)) or read[-1])
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, {"x": F.col("x")}, probs, finish=100)["x"]
    s = np.sort(values)
    for p, g in zip(probs, got):
        h = p * (len(s) - 1)
        a, b = s[int(h)], s[min(int(h) + 1, len(s) - 1)]
        assert g == a or g == b or math.isclose(g, a + (b - a) * (h - int(h)), rel_tol=1e-12)
    assert max(map(len, read), default=0) <= 100 * 2 * len(probs)


def test_nan_is_missing(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [1.0, 3.0, float("nan"), 5.0], "y": [1, 2, 3, 4]}))
    r = prof.profile(df).where("column_name = 'x'").first()
    assert (r["null_percentage"], r["distinct_count"], r["mean_value"], r["median_value"]) == (25.0, 3, 3.0, 3.0)
    assert (r["min_value"], r["max_value"]) == ("1.0", "5.0")
    out = C.clean(df)
    assert sorted(x["x"] for x in out.data.collect()) == [1.0, 3.0, 3.0, 5.0]
    assert out.null_report.where("column_name = 'x'").first()["null_percentage"] == 25.0
    assert out.outliers.where("column_name = 'x'").first()["outliers"] == 0


def test_clean_empty_frame(spark):
    r = C.clean(spark.createDataFrame([], "a double, b string")).report.first()
    assert (r["total_records"], r["processed_records"], r["duplicates_removed"]) == (0, 0, 0)


def test_numbers_of_any_size_and_script(spark):
    long30 = "1" * 30
    df = spark.createDataFrame([(1, 0, "user", f"9999999999999999999 and {long30} and ١٢٣ and 42.5"),
                                (1, 1, "assistant", f"{long30} 9999999999999999999 123 42.5"), (1, 2, "assistant", "777.25 ４２"),
                                (1, 3, "assistant", "42.54")],
                               "conv_id long, turn long, role string, text string")
    nums = df.select(T.extract_numbers(F.col("text")).alias("n")).collect()
    assert nums[0]["n"] == [42.5, 123.0, 9999999999999999999.0, float(long30)] and nums[2]["n"] == [42.0, 777.25]
    got = {r["turn"]: r["grounded"] for r in T.grounding_check(
        df.where("role = 'assistant'"), T.conversation_context(df)).collect()}
    assert got == {1: True, 2: False, 3: True}


@pytest.mark.parametrize("value,text", [
    (12345678.0, "12345678.0"), (1e-4, "0.0001"), (0.00123, "0.00123"), (-1.5e9, "-1500000000.0"), (3e8, "300000000.0"),
    (123456789.125, "123456789.125"), (1234.56, "1234.56"), (0.0, "0.0"), (1.2345678901234e15, "1234567890123400.0"),
    (1e30, "1.0E30"), (None, None)])
def test_float_text(spark, value, text):
    assert spark.createDataFrame([(value,)], "x double").select(exprs.float_text("x")).first()[0] == text


@pytest.mark.parametrize("text,expect", [
    ("1/5/2024", "2024-01-05 00:00:00"), ("01/05/2024", "2024-01-05 00:00:00"), ("2024/1/5", "2024-01-05 00:00:00"),
    ("5-Jan-2024", "2024-01-05 00:00:00"), ("13/01/2024", "2024-01-13 00:00:00"), ("January 5, 2024", "2024-01-05 00:00:00"),
    ("5 January 2024", "2024-01-05 00:00:00"), ("01/05/2024 10:30", "2024-01-05 10:30:00"),
    ("2024-01-05T10:00:00Z", "2024-01-05 10:00:00"), ("2024-01-05T10:00:00+02:00", "2024-01-05 08:00:00"),
    ("2024-01-05", "2024-01-05 00:00:00"), ("May 5, 2024", "2024-05-05 00:00:00"), ("32/01/2024", None), ("hello world", None)])
def test_date_shapes(spark, text, expect):
    df = spark.createDataFrame([(text,)], "x string")
    got = df.select(C.parse_date("x").cast("string").alias("a"), F.expr(C.parse_date_sql("x")).cast("string").alias("b")).first()
    assert got["a"] == expect and got["b"] == expect


def test_csv_dialect(spark, tmp_path):
    p = tmp_path / "up.csv"
    p.write_text('id,note,extra\n1,"x ""y"" z",a\n2,"two\nlines, and a comma",b\n3,short\n')
    rows = [tuple(r) for r in upload.read_upload_csv(spark, str(p)).collect()]
    assert rows == [("1", 'x "y" z', "a"), ("2", "two\nlines, and a comma", "b"), ("3", "short", None)]
    p2 = tmp_path / "long.csv"
    p2.write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="too many values"):
        upload.read_upload_csv(spark, str(p2)).collect()


def test_forecast_plans_have_no_cross_join(spark):
    from ledgerlens import registry

    for name in ("f8_linear_forecast", "f9_history_and_forecast", "f10_forecast_digest"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_linear_fit_by_sums(spark):
    y = [3.0, 4.5, 1.0, 7.0, 9.0]
    df = spark.createDataFrame([("a", f"2024-03-0{i + 1}", v) for i, v in enumerate(y)] + [("b", "2024-01-01", 2.0)],
                               "sid string, d string, y double").withColumn("d", F.col("d").cast("date"))
    rows = {r["sid"]: r for r in fc.linear_fit(df).collect()}
    slope, intercept = np.polyfit(range(5), y, 1)
    assert math.isclose(rows["a"]["slope"], slope) and math.isclose(rows["a"]["intercept"], intercept)
    assert math.isclose(rows["a"]["sigma"], np.std(y - (intercept + slope * np.arange(5))))
    assert (rows["b"]["slope"], rows["b"]["sigma"]) == (0.0, 10.0)


def test_empty_dashboard(spark):
    from ledgerlens.operators import dashboard

    rows = {(r["section"], r["label"]): r["value"] for r in dashboard.empty_dashboard(spark).collect()}
    assert rows["header", "record_count"] == "0" and rows["header", "domain"] == "Generic Business Dataset"
    assert rows["insight", ""].startswith("No business datasets uploaded yet.")


def test_stored_metadata_feeds_the_report(spark, tmp_path):
    from ledgerlens.operators import digest, reports
    from ledgerlens.sources import catalog

    df = spark.createDataFrame([(1, "a", 2.5), (2, "b", 3.5)], "order_id int, city string, price double")
    p = prof.profile(df)
    insights = prof.ingest_insights(p, prof.classify_domain(p), df.agg(F.count(F.lit(1)).alias("n")))
    for name in ("d1", "d2"):
        catalog.store_metadata(str(tmp_path), name, p, prof.suggest_kpis(p), insights)
    stored = catalog.stored_metadata(spark, str(tmp_path), "column_metadata", "d1")
    assert sorted(stored.collect()) == sorted(p.select(stored.columns).collect())
    assert sorted(reports.profile_section(stored).collect()) == sorted(reports.profile_section(p).collect())
    assert sorted(digest.column_digest(stored).collect()) == sorted(digest.column_digest(p).collect())
    assert catalog.stored_metadata(spark, str(tmp_path), "generated_kpis", "d2").count() == prof.suggest_kpis(p).count()


def test_metadata_matches_the_profile(spark):
    df = spark.createDataFrame([(i, "yes" if i % 2 else "no", str(i * 1.5), f"n{i % 7}", i % 2 == 0) for i in range(40)],
                               "order_id int, is_open string, amount_text string, thing string, flag boolean")
    cols = ["ordinal", "column_name", "data_type", "semantic_type"]
    got, full = prof.column_metadata(df), prof.profile(df).select(cols)
    assert [r["semantic_type"] for r in got.orderBy("ordinal").collect()] == [
        r["semantic_type"] for r in full.orderBy("ordinal").collect()]


def test_uploads_are_split_unless_values_hold_line_breaks(spark, tmp_path):
    from ledgerlens.sources import upload
    plain = ['a,b', '1,"x ""y"", z"', '2,""', '3,"""q"""', '"",w', '4,"' + "long " * 20000 + '"']
    broken = [['a,b', '1,"x', 'y"'], ['a,b', '1"0,"x', 'y"'], ['a,b', '1,"x "" ', '"" y"']]
    p = tmp_path / "plain.csv"
    p.write_text("\n".join(plain) + "\n")
    assert not upload.breaks_in_values(spark, str(p))
    assert [r["b"][:9] if r["b"] else r["b"] for r in upload.read_upload_csv(spark, str(p)).collect()] == ['x "y", z', None, '"q"', "w", "long long"]
    for k, lines in enumerate(broken):
        q = tmp_path / f"broken{k}.csv"
        q.write_text("\n".join(lines) + "\n")
        assert upload.breaks_in_values(spark, str(q))
        assert upload.check_upload(spark, "q.csv", str(q)).count() == 1
    big = tmp_path / "big.csv"
    big.write_text("a,b\n" + "".join(f'{i},"v {i}"\n' for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = upload.check_upload(spark, "big.csv", str(big))
        assert df.rdd.getNumPartitions() > 1 and df.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
