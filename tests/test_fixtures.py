"""The reference's unit tests, re-expressed on the Spark operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import rules
from ledgerlens.operators import clean as C
from ledgerlens.operators import conversations as T
from ledgerlens.operators import profile as P
from ledgerlens.operators import quality as Q


def test_cleaning_retail(spark):
    # F-A: median imputation, mode imputation, outliers counted
    rows = [(5.0, "$10.00", 5.0, 10.0, "Electronics"), (10.0, "10.00", 5.0, 10.0, None),
            (None, "10.00", 5.0, 10.0, "Electronics"), (500.0, "10.00", 5.0, 10.0, "Electronics")]
    df = spark.createDataFrame(rows, "quantity double, unit_price string, cost_price double, "
                                     "list_price double, category_name string").coalesce(1)
    res = C.clean(df)
    rep = res.report.first()
    assert rep["total_records"] == 4
    out = res.data.collect()
    assert [r["quantity"] for r in out].count(10.0) == 2  # the null became the median 10
    assert all(r["category_name"] == "Electronics" for r in out)
    assert rep["outliers_detected"] > 0
    assert "net_amount" in res.data.columns  # C14: quantity x unit_price


def test_cleaning_hr(spark):
    # F-B: duplicates, salary text, Active/Inactive, tie-breaks, date fill
    rows = [("John Doe", "$5,000.00", "Active", "2024-01-10"),
            ("Jane Smith", "$6,000.00", "Inactive", "2024-02-15"),
            (None, None, None, None),
            ("John Doe", "$5,000.00", "Active", "2024-01-10")]
    df = spark.createDataFrame(rows, "employee_name string, monthly_salary string, is_active string, "
                                     "hire_date string").coalesce(1)
    res = C.clean(df)
    assert res.report.first()["total_records"] == 4
    assert res.report.first()["duplicates_removed"] == 1
    kinds = {r["column_name"]: r["inferred_type"] for r in res.types.collect()}
    # whole amounts after stripping "$" and "," -> Integer (stored as double)
    assert kinds == {"employee_name": "Text", "monthly_salary": "Integer", "is_active": "Boolean",
                     "hire_date": "DateTime"}
    data = {r["monthly_salary"]: r for r in res.data.collect()}
    assert set(data) == {5000.0, 6000.0, 5500.0}
    assert data[5000.0]["is_active"] is True and data[6000.0]["is_active"] is False
    assert data[5500.0]["is_active"] is False            # tie -> False
    assert data[5500.0]["employee_name"] == "Jane Smith"  # tie -> smallest
    assert data[5500.0]["hire_date"] == dt.datetime(2024, 2, 15)  # forward fill in row order


def test_profile_hr(spark):
    # F-C: four profile rows, salary is Monetary, domain HR >= 40
    rows = [(50000, "EMP01", "No", "2024-01-10"), (60000, "EMP02", "Yes", "2024-02-15"),
            (55000, "EMP03", "No", "2024-03-20")]
    df = spark.createDataFrame(rows, "salary bigint, employee_id string, attrition string, hire_date string")
    prof = P.profile(df)
    got = {r["column_name"]: r for r in prof.collect()}
    assert len(got) == 4
    assert got["salary"]["semantic_type"] == "Monetary"
    assert got["salary"]["data_type"] == "Integer"
    assert got["salary"]["median_value"] == 55000.0
    d = P.classify_domain(prof).first()
    assert d["domain"] == "HR" and d["confidence_score"] >= 40.0


@pytest.mark.parametrize("names,expected", [
    (["employee_id", "monthly_salary", "hire_date", "job_role"], "HR"),
    (["patient_id", "admission_date", "diagnosis_code", "doctor_name"], "Healthcare"),
    (["a", "b"], rules.GENERIC_DOMAIN),
])
def test_domain_rules(spark, names, expected):
    # F-F
    prof = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "ordinal int, column_name string")
    assert P.classify_domain(prof).first()["domain"] == expected


def test_semantic_name_rules(spark):
    # first match wins, Boolean name rule needs <= 5 distinct values
    rows = [("discount", "Float", 10), ("payment_method", "Text", 3), ("customer_code", "Text", 50),
            ("is_active", "Boolean", 2), ("status", "Text", 9), ("notes", "Text", 2), ("qty", "Float", 40)]
    df = spark.createDataFrame(rows, "column_name string, data_type string, distinct_count long")
    got = dict(df.select("column_name", P.semantic_type(F.col("column_name"), F.col("data_type"),
                                                        F.col("distinct_count"))).collect())
    assert got == {"discount": "Quantity", "payment_method": "Monetary", "customer_code": "Text",
                   "is_active": "Boolean", "status": "Text", "notes": "Boolean", "qty": "Quantity"}


def test_negative_uploads(spark, tmp_path):
    # F-G: empty file, unsupported extension, binary data named .csv
    from ledgerlens.sources.upload import UploadError, check_upload
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    with pytest.raises(UploadError):
        check_upload(spark, "empty.csv", str(empty))
    with pytest.raises(UploadError):
        check_upload(spark, "data.txt", str(empty))
    binary = tmp_path / "bin.csv"
    binary.write_bytes(bytes(range(256)) * 4)
    with pytest.raises(UploadError):
        check_upload(spark, "bin.csv", str(binary))
    good = tmp_path / "good.csv"
    good.write_text("a,b\n1,NA\n2,x\n")
    df = check_upload(spark, "good.csv", str(good))
    assert sorted(df.collect(), key=lambda r: r["a"])[0]["b"] is None  # NA token -> null


def test_constraint_violations(spark):
    # F-H: cost >= 0 and list >= cost
    df = spark.createDataFrame([("SKU-NEG-COST", -10.0, 10.0), ("SKU-BAD-REL", 20.0, 15.0), ("OK", 1.0, 2.0)],
                               "sku string, cost_price double, list_price double")
    checks = {"cost_price >= 0": F.col("cost_price") >= 0, "list_price >= cost_price":
              F.col("list_price") >= F.col("cost_price")}
    got = {r["rule"]: r["violations"] for r in Q.check_rules(df, "products", checks).collect()}
    assert got == {"cost_price >= 0": 1, "list_price >= cost_price": 1}
    bad = {r["sku"]: r["broken_rules"] for r in Q.violating_rows(df, checks).collect()}
    assert bad == {"SKU-NEG-COST": ["cost_price >= 0"], "SKU-BAD-REL": ["list_price >= cost_price"]}


def test_owner_isolation(spark, tmp_path):
    # F-I: another owner sees no dataset; requests fall back to the owner's latest
    from ledgerlens.sources import catalog as K
    root = str(tmp_path / "store")
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    K.publish(df, root, "ds1", "one.csv", "owner-a", "Retail", 40.0, 1)
    cat = K.read_catalog(spark, root, "datasets")
    assert K.list_datasets(cat, "owner-b").count() == 0
    assert [r["dataset_id"] for r in K.list_datasets(cat, "owner-a").collect()] == ["ds1"]
    req = spark.createDataFrame([("owner-a", "nope"), ("owner-b", "ds1"), ("owner-a", "ds1")],
                                "owner string, dataset_id string")
    got = {(r["owner"], r["requested_id"]): r["resolved_id"] for r in K.resolve_datasets(cat, req).collect()}
    assert got == {("owner-a", "nope"): "ds1", ("owner-b", "ds1"): None, ("owner-a", "ds1"): "ds1"}


def test_grounding(spark):
    # F-J: $1500.25 is grounded in $1,500.25; $23,450.00 is not
    ctx = "=== DASHBOARD KPIS ===\n- Gross Revenue: $1,500.25 (Formula: SUM(sales))\n- Net Profit: $350.00"
    turns = spark.createDataFrame(
        [(1, 0, "system", ctx), (1, 1, "assistant", "The calculated Gross Revenue is $1500.25."),
         (2, 0, "system", ctx), (2, 1, "assistant", "The calculated Gross Revenue is $23,450.00."),
         (3, 0, "system", ctx), (3, 1, "assistant", "Only 5 of 100 rows; " + rules.FALLBACK_TEXT.upper())],
        "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in T.grounding_check(turns.where("role = 'assistant'"),
                                                      T.conversation_context(turns)).collect()}
    assert out[1]["grounded"] and out[1]["text"].endswith("$1500.25.")
    assert not out[2]["grounded"] and out[2]["text"] == rules.FALLBACK_TEXT
    assert not out[3]["grounded"] and out[3]["text"] == rules.FALLBACK_TEXT


def test_intents(spark):
    df = spark.createDataFrame([("Give me a summary",), ("What is the revenue?",), ("forecast please",),
                                ("customer groups",), ("hello",)], "text string")
    got = [r[0] for r in df.select(T.intent(F.col("text"))).collect()]
    assert got == ["summary", "kpi", "forecast", "segment", "fallback"]


def test_numbers(spark):
    df = spark.createDataFrame([("a 1,234.5 b 7 c 7 d x9 10.25",)], "text string")
    assert df.select(T.extract_numbers(F.col("text"))).first()[0] == [7.0, 10.25, 1234.5]
    assert not math.isnan(1.0)


def test_kpi_formatting_and_errors(spark):
    from ledgerlens.operators import dashboard as D
    df = spark.createDataFrame([(1234.5, 3, 0.25), (1000.0, 4, 0.75)], "sales double, units int, rate double")
    got = {r["kpi_name"]: r["value"] for r in D.evaluate_kpis(
        df, [("s", "SUM(sales)"), ("n", "COUNT(units)"), ("r", "AVG(rate)"), ("bad", "SUM(no_such_col)"),
             ("u", "SUM(units)")]).collect()}
    assert got == {"s": "$2,234.50", "n": "2", "r": "0.50", "bad": "Error", "u": "7"}
