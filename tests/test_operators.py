import hashlib
import random
import time
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlane.operators import integrity, issues, metrics, preflight, reconcile, rules, timing
from ledgerlane.streaming.deposits import deposit_timing

SIDE = "employee_id string, {} date, pretax decimal(18,2), roth decimal(18,2), loan decimal(18,2)"


def money(*xs):
    return tuple(Decimal(str(x)) for x in xs)


def side(spark, rows, date_name):
    return spark.createDataFrame([(e, d, *money(*m)) for e, d, *m in rows], SIDE.format(date_name))


@pytest.fixture(scope="module")
def sides(spark):
    payroll = [("1", date(2025, 1, 3), 100, 0, 10), ("1", date(2025, 1, 17), "0.10", "0.20", 0), ("2", date(2025, 1, 3), 50, 0, 0), ("3", date(2025, 1, 3), 5, 0, 0), (None, date(2025, 1, 3), 9, 9, 9)]
    rk = [("1", date(2025, 1, 6), "100.30", 0, 10), ("2", date(2025, 1, 20), 60, 0, 5), ("4", None, 1, 0, 0), (None, date(2025, 1, 9), 9, 9, 9)]
    return side(spark, payroll, "pay_date"), side(spark, rk, "deposit_date")


def by(df, key="employee_id"):
    return {r[key]: r for r in df.collect()}


def test_reconciliation(sides):
    both = reconcile.joined(*sides)
    rows = by(reconcile.stream(both, "deferrals"))
    assert {k: r["merge_status"] for k, r in rows.items()} == {"1": "both", "2": "both", "3": "left_only", "4": "right_only"}
    assert rows["1"]["delta"] == 0 and rows["2"]["delta"] == -10 and rows["3"]["delta"] is None
    assert set(by(reconcile.mismatches(reconcile.stream(both, "deferrals")))) == {"2"}
    assert not by(reconcile.mismatches(reconcile.stream(both, "deferrals"), tolerance=10))
    assert set(by(reconcile.mismatches(reconcile.stream(both, "loans")))) == {"2"}
    assert set(by(reconcile.late(reconcile.stream(both, "deferrals")))) == {"2"}
    assert rows["1"]["business_days_lag"] == 1 and rows["2"]["business_days_lag"] == 11


def test_reconciliation_laws(sides):
    payroll, rk = sides
    p = payroll.withColumnRenamed("pay_date", "deposit_date")
    same = reconcile.stream(reconcile.joined(payroll, p), "deferrals")
    assert same.filter("merge_status <> 'both' or delta <> 0").count() == 0
    there = reconcile.stream(reconcile.joined(payroll, rk), "deferrals")
    back = reconcile.stream(reconcile.joined(rk.withColumnRenamed("deposit_date", "pay_date"), p), "deferrals")
    assert set(by(reconcile.only_in(there, "left_only"))) == set(by(reconcile.only_in(back, "right_only")))
    total = there.filter("merge_status = 'both'").agg(F.sum("delta"), F.sum("amount_payroll") - F.sum("amount_rk")).first()
    assert total[0] == total[1]
    assert reconcile.row_level(payroll, rk).count() == 2 + 1 + 1 + 1


def test_timing(sides, spark):
    detail = timing.detail(*sides)
    got = {(r["employee_id"], r["pay_date"].day): (r["days_to_deposit"], r["is_late"], r["missing_deposit"]) for r in detail.collect()}
    assert got == {("1", 3): (3, False, False), ("1", 17): (0, False, False), ("2", 3): (17, True, False), ("3", 3): (None, False, True)}
    assert tuple(timing.summary(*sides).first()) == (4, 1, 1, "High")
    assert tuple(timing.summary(*[s.limit(0) for s in sides]).first()) == (0, 0, 0, "Low")


def counted_by_pairs(detail):
    return tuple(detail.agg(
        F.count(F.lit(1)), F.count_if("is_late"), F.count_if("missing_deposit"), F.count("days_to_deposit"), F.coalesce(F.sum("days_to_deposit"), F.lit(0)), F.max("days_to_deposit")
    ).first())


@pytest.mark.parametrize("late_days", [-1, 0, 5, 40])
@pytest.mark.parametrize("seed", range(3))
def test_timing_counts_match_the_pairs(spark, late_days, seed):
    rng = random.Random(seed)
    day = lambda: rng.choice([None, *[date(2025, 1, 1) + timedelta(days=rng.randrange(60)) for _ in range(9)]])
    ids = [None, "1", " 1", "2", "3 ", "4", "5", "6", "7"]
    payroll = side(spark, [(rng.choice(ids[:-2]), day(), 1, 0, 0) for _ in range(80)], "pay_date")
    rk = side(spark, [(rng.choice(ids[3:]), day(), 1, 0, 0) for _ in range(60)], "deposit_date")
    detail = timing.detail(payroll, rk, late_days)
    assert tuple(timing.counts(payroll, rk, late_days).first()) == counted_by_pairs(detail)
    key = lambda df: sorted((str(tuple(r)) for r in df.select(*detail.columns).collect()))
    assert key(timing.exceptions(payroll, rk, late_days)) == key(detail.filter("is_late or missing_deposit"))


def test_timing_counts_of_a_large_participant(spark):
    """One participant with 10^5 rows a side: 10^10 pairs are counted, not made."""
    many = lambda name, k: spark.range(100_000).select(
        F.lit("1").alias("employee_id"), F.date_add(F.lit("2025-01-01").cast("date"), (F.col("id") * k % 100).cast("int")).alias(name),
        *[F.lit(1).cast("decimal(18,2)").alias(c) for c in ("pretax", "roth", "loan")],
    )
    payroll, rk = many("pay_date", 7), many("deposit_date", 3)
    began = time.time()
    got = timing.counts(payroll, rk).first()
    assert time.time() - began < 20
    lags = [b - a for a in range(100) for b in range(100)]
    assert (got["total_rows"], got["late_rows"], got["pairs"]) == (10**10, 10**6 * sum(x > 5 for x in lags), 10**10)
    assert (got["total_days"], got["max_days"], got["missing_deposits"]) == (10**6 * sum(max(x, 0) for x in lags), 99, 0)
    plan = timing.summary(payroll, rk)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("partial_sum") >= 1


def test_metrics(sides):
    both = reconcile.joined(*sides)
    r = metrics.mismatch_counts(both).first()
    assert tuple(r) == (1, 1, 1, 1, 1, 1)
    values = {(x["category"], x["metric"]): x["value"] for x in metrics.compliance_metrics(both).collect()}
    assert len(values) == 12 and values["Late Contributions", "Max business-day lag (late rows only)"] == 11
    text = metrics.narrative(both, timing.summary(*sides), metrics.sample_ids(reconcile.mismatches(reconcile.stream(both, "deferrals")))).first()[0]
    assert text == "1 deferral and 1 loan amounts differ between payroll and recordkeeper; 1 participants were paid in late; differing deferrals include participants 2; risk of this run: High."


def people(spark, rows):
    schema = "employee_id string, age int, is_hce boolean, pay_date date, pretax decimal(18,2), roth decimal(18,2), catchup_pretax decimal(18,2), catchup_roth decimal(18,2)"
    return spark.createDataFrame([(e, a, h, d, *money(*m)) for e, a, h, d, *m in rows], schema)


def test_catch_up_rules(spark):
    day = date(2024, 3, 1)
    rows = people(spark, [("a", 52, True, day, 10, 0, 5, 0), ("b", 52, True, day, 10, 0, 5, 5), ("c", 60, False, day, 10, 1, 0, 0), ("d", 30, True, day, 10, 0, 0, 0), ("e", None, True, day, 1, 0, 5, 0)])
    got = {k: r["violation_type"] for k, r in by(rules.secure20(rows)).items()}
    assert got == {"a": rules.HCE_ROTH, "c": rules.MISCODED}
    assert tuple(rules.secure20_summary(rules.secure20(rows)).first()) == (2, 1, 1)
    assert set(by(rules.secure20_demo(rows))) == {"a"} | {"b"}
    born = rows.drop("age").withColumn("dob", F.lit("1970-01-01").cast("date"))
    assert by(rules.secure20(born))["a"]["age"] == 54
    # A row without an age gets that of its date of birth; one with an age keeps it.
    both = people(spark, [("f", None, True, day, 10, 0, 5, 0), ("g", 20, True, day, 10, 0, 5, 0)]).withColumn("dob", F.lit("1960-01-01").cast("date"))
    assert {k: r["age"] for k, r in by(rules.secure20(both)).items()} == {"f": 64}
    assert rules.secure20(rows.limit(0)).columns == rules.secure20(rows).columns


def test_annual_limit(spark):
    rows = people(spark, [("a", 40, False, date(2024, 1, 5), 23000, "0.01", 0, 0), ("b", 55, False, date(2024, 1, 5), 30000, 0, 0, 0), ("c", 40, False, date(2023, 1, 5), 25000, 0, 1, 0), ("d", 40, False, date(1999, 1, 5), 23001, 0, 0, 0), ("e", 40, False, None, 90000, 0, 0, 0)])
    assert {k: float(r["excess_amount"]) for k, r in by(rules.deferral_excess(rules.deferral_totals(rows))).items()} == {"a": 0.01, "d": 1}
    assert set(by(rules.deferral_totals(rows, 2023))) == {"c"}
    own = by(rules.deferral_totals(rows, limits={2024: (40000, 0), 2030: (50000, 0)}))
    assert {k: float(r["base_limit"]) for k, r in own.items()} == {"a": 40000, "b": 40000, "c": 50000, "d": 50000}


def test_eligibility(spark):
    d = date
    dates = spark.createDataFrame([
        ("late", d(2020, 1, 15), d(1990, 1, 1), d(2021, 3, 1)), ("fine", d(2020, 1, 15), d(1990, 1, 1), d(2021, 1, 20)), ("none", d(2020, 1, 15), d(1990, 1, 1), None),
        ("young", d(2020, 1, 15), d(2004, 2, 29), d(2025, 3, 1)), ("unknown", None, None, d(2020, 1, 1)),
    ], "employee_id string, hire_date date, dob date, first_deferral_date date")
    got = by(rules.eligibility_drift(dates, rules.EligibilityRule()))
    assert {k: (r["issue_type"], r["drift_days"]) for k, r in got.items()} == {"late": (rules.LATE_START, 46), "none": (rules.NO_START, None)}
    aligned = by(rules.eligibility_drift(dates, rules.EligibilityRule(align_first_month=True), 0))
    assert aligned["late"]["computed_eligibility_date"] == d(2021, 2, 1)
    assert by(rules.eligibility_drift(dates, rules.EligibilityRule("age_only"), 0))["young"]["computed_eligibility_date"] == d(2025, 2, 28)
    assert by(rules.eligibility_drift(dates, rules.EligibilityRule("immediate")))["late"]["computed_eligibility_date"] == d(2020, 1, 15)


def test_match_and_termination(spark):
    rows = spark.createDataFrame([("ok", *money(1000, 60, 30)), ("under", *money(10000, 600, 100)), ("over", *money(10000, 600, 500)), ("near", *money(1000, 60, 27)), ("zero", *money(0, 0, 5))],
        "employee_id string, compensation decimal(18,2), deferral decimal(18,2), er_match decimal(18,2)").withColumn("pay_date", F.lit("2025-01-01").cast("date"))
    assert {k: r["issue_type"] for k, r in by(rules.match_check(rows)).items()} == {"under": "Under-match", "over": "Over-match"}
    gone = rows.select("employee_id", "pay_date", F.lit("Terminated").alias("employment_status"), F.lit("2024-12-31").cast("date").alias("termination_date"), F.col("deferral").alias("pretax"), F.lit(0).cast("decimal(18,2)").alias("roth"))
    assert set(by(rules.post_termination(gone))) == {"ok", "under", "over", "near"} and not by(rules.post_termination(gone, 1))


def test_issue_union_and_health(spark):
    one = spark.createDataFrame([("1", "Under-match", 1000.0, 30.0, None, -5.0)], "employee_id string, issue_type string, eligible_comp double, expected_match double, er_match_amount double, variance double")
    two = spark.createDataFrame([("2",)], "employee_id string")
    got = by(issues.union_issues({"match": issues.with_metadata(one), "other": two}, "r", "p", 2024))
    assert got["1"]["details"] == "Match issue_type=Under-match, eligible_comp=$1000.00, expected_match=$30.00, variance=$-5.00."
    assert (got["2"]["issue_type"], got["2"]["issue_category"], got["2"]["severity"]) == ("other", "Other", "Medium")
    health = issues.plan_health(issues.union_issues({"match": issues.with_metadata(one)}, "r", None, None), spark.range(20).selectExpr("cast(id as string) as employee_id")).first()
    assert (health["score"], health["grade"], health["risk_level"]) == (90.0, "A", "Low")
    assert issues.taxonomy(spark).count() == 7


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 1024, 1025, 2500])
def test_merkle_root(spark, n):
    hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    leaves = spark.createDataFrame([(i, h) for i, h in enumerate(hashes)], "index_ long, row_hash string")
    level = hashes
    while len(level) > 1:
        level = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(level[::2], [*level[1::2], level[-1]] if len(level) % 2 else level[1::2], strict=True)]
    assert integrity.merkle_root(leaves, n).first()[0] == (level[0] if level else "")


def test_row_hash_and_index(spark):
    df = spark.createDataFrame([(f"e{i:03}", None if i == 5 else i) for i in range(300)], "b string, a int")
    got = {r["b"]: r["row_hash"] for r in integrity.row_hashes(df).collect()}
    assert got["e005"] == hashlib.sha256(b"a=nan|b=e005").hexdigest() and got["e007"] == hashlib.sha256(b"a=7|b=e007").hexdigest()
    assert [r["b"] for r in integrity.indexed(df, "b").orderBy("index_").collect()] == [f"e{i:03}" for i in range(300)]


def test_preflight(spark):
    payroll = spark.createDataFrame([("1", "2025-01-03", "5"), (" ", "2025-01-03", "5")], "`Emp ID` string, `Check Date` string, `EE Deferral $` string")
    rk = spark.createDataFrame([("1", "5")], "employee_id string, amount string")
    mapping = {"payroll": {"id": {"canonical": "employee_id", "examples": ["emp id"]}, "d": {"canonical": "pay_date", "examples": ["check date"]}, "m": {"canonical": "EE Deferral $", "examples": ["EE Deferral $"]}},
               "recordkeeper": {"id": {"canonical": "employee_id", "examples": []}, "m": {"canonical": "amount", "examples": ["amount"]}}}
    report = preflight.run(payroll, rk, mapping)
    assert report.safe and report.coverage == {"payroll": 50.0, "recordkeeper": 100.0} and len(report.warnings) == 2
    assert not preflight.run(payroll.drop("Emp ID"), rk, mapping).safe and not preflight.run(payroll.limit(0), rk, mapping).safe
    assert "BLOCKED" in preflight.run(payroll.drop("Emp ID"), rk, mapping).lines()[0]


def test_streamed_timing(spark, tmp_path):
    import json
    import os

    for name, batches in {
        "pay": [[("1", "2025-01-03"), ("2", "2025-01-03")], [("9", "2025-06-01")], [("9", "2025-06-02")]],
        "dep": [[("1", "2025-01-06"), ("1", "2025-01-20")], [("9", "2025-06-01")], [("9", "2025-06-02")]],
    }.items():
        (tmp_path / name).mkdir()
        for i, rows in enumerate(batches):
            key = "pay_date" if name == "pay" else "deposit_date"
            file = tmp_path / name / f"{i}.json"
            file.write_text("\n".join(json.dumps({"employee_id": e, key: d}) for e, d in rows))
            os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in order of their times
    read = lambda n, k: spark.readStream.schema(f"employee_id string, {k} date").option("maxFilesPerTrigger", 1).json(str(tmp_path / n))
    out = deposit_timing(read("pay", "pay_date"), read("dep", "deposit_date"))
    out.writeStream.format("memory").queryName("timed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["employee_id"], r["days_to_deposit"], r["is_late"], r["missing_deposit"]) for r in spark.table("timed").filter("employee_id <> '9'").collect()}
    assert got == {("1", 3, False, False), ("1", 17, True, False), ("2", None, False, True)}


def test_match_plan_reads_each_column_a_few_times(spark):
    """The amounts are not spelt out again in every filter and lookup that reads the classification."""
    rows = spark.range(3).selectExpr("cast(id as string) as employee_id", "current_date() as pay_date", "cast(id + rand() as decimal(18,2)) as compensation", "cast(id as decimal(18,2)) as deferral", "cast(id as decimal(18,2)) as er_match")
    plan = rules.match_check(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rand(") == 1 and len(plan) < 20_000
