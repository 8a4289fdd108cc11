from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlane.functions.scalar import business_days, business_days_after
from ledgerlane.operators import reconcile, timing
from ledgerlane.plans.engine import Engine
from ledgerlane.sources import files, generate
from ledgerlane.sources.generate import Size


def test_dates_after_weekdays(spark):
    days = spark.range(21).crossJoin(spark.range(15).toDF("n")).select(F.date_add(F.lit("2024-12-28").cast("date"), F.col("id").cast("int")).alias("d"), "n")
    for r in days.withColumn("on", business_days_after(F.col("d"), F.col("n"))).collect():
        assert r["on"] == np.busday_offset(r["d"], r["n"], roll="backward").astype(date)


@pytest.mark.parametrize("plan", [generate.synthetic_plan, generate.clean_plan, generate.messy_plan, generate.catch_up_plan])
def test_rows_do_not_depend_on_partitioning(spark, plan):
    once = [sorted(map(str, side.collect())) for side in plan(spark)]
    before = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "13")
    try:
        assert [sorted(map(str, side.collect())) for side in plan(spark)] == once
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism") if before is None else spark.conf.set("spark.sql.leafNodeDefaultParallelism", before)
    assert [sorted(map(str, side.collect())) for side in plan(spark, Size(40, 6, seed=1))] != once


def near(share, wanted, n):
    """Within four standard deviations of a share of n draws."""
    return abs(share - wanted) < 4 * (wanted * (1 - wanted) / n) ** 0.5


def test_shares_of_a_synthetic_plan(spark):
    n = 60_000
    payroll, rk = generate.synthetic_plan(spark, Size(10_000, 6))
    assert payroll.count() == rk.count() == n and payroll.select("EmpNumber").distinct().count() == 10_000
    both = payroll.join(rk, (payroll["EmpNumber"] == rk["Part_ID"]) & (F.datediff(rk["Post_Date"], payroll["Payroll_Run_Date"]).between(1, 14)))
    lag = both.select(business_days(F.col("Payroll_Run_Date"), F.col("Post_Date")).alias("lag"), (F.col("PreTax_Defl") != F.col("EE_PreTax")).alias("off"), "PreTax_Defl")
    got = lag.agg(F.count("*").alias("n"), F.avg((F.col("lag") <= 3).cast("int")), F.avg((F.col("lag").between(4, 5)).cast("int")), F.avg((F.col("lag") > 5).cast("int")), F.max("lag")).first()
    assert got["n"] == n and near(got[1], 0.70, n) and near(got[2], 0.25, n) and near(got[3], 0.05, n) and got[4] == 10
    paid = lag.filter("PreTax_Defl > 0")
    assert near(paid.agg(F.avg(F.col("off").cast("int"))).first()[0], 0.10, paid.count())
    assert near(payroll.filter("PreTax_Defl = 0").select("EmpNumber").distinct().count() / 10_000, 0.15, 10_000)


def test_shares_of_a_messy_plan(spark):
    n = 40_000
    payroll, rk = generate.messy_plan(spark, Size(5_000, 8))
    there = rk.count()
    assert near(1 - there / n, 0.12, n)
    same = payroll.alias("p").join(rk.alias("r"), (F.col("p.employee_id") == F.col("r.employee_id")) & F.datediff("record_date", "pay_date").between(1, 12))
    got = same.agg(F.count("*"), F.avg((F.col("p.def_amount") != F.col("r.def_amount")).cast("int")), F.avg((F.datediff("record_date", "pay_date") > 5).cast("int"))).first()
    assert got[0] == there and near(got[1], 0.22, there) and near(got[2], 0.18, there)


def test_demos_run_as_stated(spark):
    engine = Engine(spark)
    text = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    run = lambda sides: engine.run(*[text(s).withColumnRenamed("record_date", "deposit_date") for s in sides])
    clean = run(generate.clean_plan(spark)).summary
    assert (clean["deferral_mismatch_count"], clean["only_payroll_count"], clean["late_deferral_count"], clean["timing"]["missing_deposits"]) == (0, 0, 0, 0)
    messy = run(generate.messy_plan(spark)).summary
    assert messy["deferral_mismatch_count"] > 60  # of 80 participants with a missing or differing row in eight
    payroll, rk = generate.catch_up_plan(spark)
    hit = payroll.filter("is_hce = 1 and age >= 50")
    assert hit.count() > 0 and hit.filter("roth_amount > 0 or def_amount < 160").count() == 0 and rk.count() == 480
    synthetic = generate.synthetic_plan(spark)
    p, vendor, _ = files.prepared(text(synthetic[0]), "payroll")
    assert p.agg(F.sum("pretax")).first()[0] == synthetic[0].agg(F.sum("PreTax_Defl")).first()[0]


def test_a_third_of_all_rows_are_one_participants(spark):
    """The timing figures of a skewed plan come from days, not from its 5 * 10^9 pairs."""
    size = Size(40_000, 6, hot_share=1 / 3)
    payroll, rk = generate.messy_plan(spark, size, missing=0.0)
    p, r = files.prepared(payroll, "payroll")[0], files.prepared(rk.withColumnRenamed("record_date", "deposit_date"), "rk")[0]
    hot = payroll.filter("employee_id = 'E1000'").count()
    assert near(hot / 240_000, 1 / 3, 240_000)
    got = timing.counts(p, r).first()
    assert got["total_rows"] > hot * hot and got["missing_deposits"] == 0
    small = [d.filter("employee_id <> 'E1000'") for d in (p, r)]
    detail = timing.detail(*small)
    assert timing.counts(*small).first()["late_rows"] == detail.filter("is_late").count()
    assert reconcile.joined(p, r).count() == payroll.select("employee_id").distinct().count()
