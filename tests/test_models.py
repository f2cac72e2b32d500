"""Invariants of the model-based operators on the small driver tables."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerlens.functions import rules
from ledgerlens.operators import forecast as fc
from ledgerlens.operators import segment as sg
from ledgerlens.sources.tables import Tables


def test_kmeans_segments_invariants(spark):
    seg = sg.segment_customers(Tables(spark, SF_SMALL).orders, "o_custkey", "o_totalprice", "o_orderdate")
    summ = sg.segment_summary(seg).collect()
    assert abs(sum(r["percentage"] for r in summ) - 100.0) < 0.05
    by_label = {r["segment_name"]: r["avg_monetary"] for r in summ}
    order = [by_label[s] for s in rules.SEGMENT_LABELS if s in by_label]
    assert order == sorted(order, reverse=True)  # labels follow mean spend
    assert seg.count() == Tables(spark, SF_SMALL).orders.select("o_custkey").distinct().count()


def test_rule_segments_for_few_customers(spark):
    df = spark.createDataFrame([("a", "2024-01-01", 5.0), ("a", "2024-01-02", 5.0), ("a", "2024-01-03", 1.0),
                                ("b", "2023-10-01", 2.0)], "c string, d string, v double") \
        .withColumn("d", F.to_timestamp("d"))
    got = {r["customer_code"]: r["segment"] for r in sg.segment_customers(df, "c", "v", "d").collect()}
    assert got == {"a": "Champions", "b": "At-Risk"}


def test_forecast_bands(spark):
    rows, acc = fc.forecast(Tables(spark, SF_SMALL).events, "ts", "value", 30, "event_type")
    fut = rows.where(F.col("forecast").isNotNull())
    assert fut.where((F.col("lower_bound") > F.col("forecast")) | (F.col("forecast") > F.col("upper_bound"))
                     | (F.col("lower_bound") < 0)).count() == 0
    assert fut.groupBy("sid").count().where("count != 30").count() == 0
    assert acc.where((F.col("mape") > rules.MAPE_CAP) | F.col("mape").isNull()).count() == 0


def test_linear_fallback_for_short_series(spark):
    df = spark.createDataFrame([("2024-01-01", 10.0), ("2024-01-02", 12.0), ("2024-01-04", 16.0)],
                               "d string, v double").withColumn("d", F.to_timestamp("d"))
    rows, acc = fc.forecast(df, "d", "v", 3)
    assert acc.first()["method"] == "linear" and acc.first()["mape"] == rules.MAPE_DEFAULT
    hist = [r["historical"] for r in rows.where("historical IS NOT NULL").orderBy("date").collect()]
    assert hist == [10.0, 12.0, 0.0, 16.0]  # the missing day is a zero
