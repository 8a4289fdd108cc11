from datetime import date

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlane.functions import fixed, headers
from ledgerlane.functions.scalar import (
    age_on, age_rounded, business_days, calendar_days, dollars, first_of_month, parse_amount, parse_date, parse_flag, ratio, years_after,
)


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_parse_amount(spark):
    texts = ["$1,234.50", " 12 ", "", None, "nan", "(100)", "12%", "1e3", "x", "-5.255"]
    assert [float(x) for x in column(spark, texts, parse_amount)] == [1234.5, 12, 0, 0, 0, 0, 0, 1000, 0, -5.26]


def test_parse_date(spark):
    texts = ["2025-01-09", "2025-1-9", "01/15/2025", "1/5/2025", "20250131", "no", None, ""]
    d = date
    assert column(spark, texts, parse_date) == [d(2025, 1, 9), d(2025, 1, 9), d(2025, 1, 15), d(2025, 1, 5), d(2025, 1, 31), None, None, None]


def test_parse_flag(spark):
    texts = ["Yes", " y ", "TRUE", "1", "1.0", "0", "0.0", "no", "maybe", "", None]
    assert column(spark, texts, parse_flag) == [True, True, True, True, True, False, False, False, False, False, False]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.dates(date(1990, 1, 1), date(2035, 1, 1)), st.integers(-400, 400)), min_size=1, max_size=60))
def test_business_days_equal_numpys(spark, pairs):
    rows = [(i, d, date.fromordinal(d.toordinal() + n)) for i, (d, n) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, a date, b date").orderBy("i")
    assert [r[0] for r in df.select(business_days(F.col("a"), F.col("b"))).collect()] == [int(np.busday_count(a, b)) for _, a, b in rows]


def test_dates_and_numbers(spark):
    df = spark.createDataFrame([(date(2025, 1, 9), date(2025, 1, 7), date(2004, 2, 29), 100.0, 0.0)], "a date, b date, dob date, x double, z double")
    a, b, dob = F.col("a"), F.col("b"), F.col("dob")
    r = df.select(
        calendar_days(a, b), calendar_days(b, a), calendar_days(a, F.lit(None).cast("date")), first_of_month(a), first_of_month(F.lit("2025-02-01").cast("date")), years_after(dob, 21),
        ratio(F.col("x"), F.col("z")), age_on(F.lit(None).cast("date"), a), age_on(dob, a), age_rounded(F.lit("2000-01-20").cast("date"), F.lit("2021-01-06").cast("date")), dollars(F.lit(1162.985)),
    ).first()
    assert tuple(r) == (0, 2, None, date(2025, 2, 1), date(2025, 2, 1), date(2025, 2, 28), 100.0, -1, 20, 21, "$1162.99")


def test_header_rules(spark):
    df = spark.createDataFrame([("1", "2", "3", "4")], "`Def_Amount` string, `pretax` string, `Roth Amount` string, other string")
    assert headers.renamed(df, headers.amount_headers(df.columns)).columns == ["EE Deferral $", "pretax", "EE Roth $", "other"]
    assert headers.aliases(["Emp ID", "EE_PreTax_Def", "Loan_Repayment", "Total Deposit Amount", "Payroll Run Date", "zip"]) == {
        "Emp ID": "employee_id", "EE_PreTax_Def": "def_amount", "Loan_Repayment": "loan_amount", "Total Deposit Amount": "amount", "Payroll Run Date": "pay_date",
    }
    assert headers.candidates(["Employee_ID", "Pay_Date", "PreTax_Defl"])["payroll_pretax"] == "PreTax_Defl"
    assert headers.logical_columns(["EE ID", "Check Date", "EE Deferral $", "EE Roth $", "Loan Repay $"], "ADP", fixed.PAYROLL_STRICT)["payroll_loan"] == "Loan Repay $"
    assert headers.name_columns(["First Name", "lastname"]) == {"First Name": "first_name", "lastname": "last_name"}


def test_vendor_detection():
    adp = ["Emp ID", "Check Date", "EE Deferral $", "EE Roth $", "Loan Repay $"]
    rk = ["Part_ID", "Post_Date", "EE_PreTax", "EE_Roth", "Loan_Contr"]
    name, score = headers.detect_vendor(adp, fixed.PAYROLL_VENDORS)
    assert name == "ADP" and 0.8 < score <= 1
    assert headers.detect_vendor(rk, fixed.RK_VENDORS)[0] == "VENDOR_RK_1"
    assert headers.detect_vendor(["a", "b"], {"V": (["zzz"], {"x": ["zzz"]})}) == (fixed.UNKNOWN_VENDOR, 0.0)
    assert headers.detect_vendor(adp, fixed.PAYROLL_VENDORS, "Mystery") == ("Mystery", score)
    assert headers.detect_vendors([], rk)["rk"] == (fixed.UNKNOWN_VENDOR, 0.0)
    assert headers.vendor_headers(rk, "VENDOR_RK_1", fixed.RK_VENDORS)["Part_ID"] == "employee_id"
