"""Deposit timing in calendar days: every payroll row against all deposits of its participant; its
figures by counting, without the pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.functions.scalar import calendar_days


def _sides(payroll: DataFrame, rk: DataFrame) -> tuple[DataFrame, DataFrame]:
    p = payroll.filter("employee_id is not null").select(
        F.trim("employee_id").alias("employee_id"), "pay_date", F.col("pretax").alias("payroll_pretax"), F.col("roth").alias("payroll_roth"),
        F.col("loan").alias("payroll_loan"), (F.col("pretax") + F.col("roth") + F.col("loan")).alias("pay_total"),
    )
    r = rk.filter("employee_id is not null").select(
        F.trim("employee_id").alias("employee_id"), "deposit_date", F.col("pretax").alias("rk_pretax"), F.col("roth").alias("rk_roth"),
        F.col("loan").alias("rk_loan"), (F.col("pretax") + F.col("roth") + F.col("loan")).alias("rk_total"),
    )
    return p, r


def _judged(pairs: DataFrame, late_days: int) -> DataFrame:
    days = calendar_days(F.col("pay_date"), F.col("deposit_date"))
    return pairs.withColumns({"days_to_deposit": days, "is_late": F.coalesce(days > late_days, F.lit(False)), "missing_deposit": F.col("deposit_date").isNull()})


def detail(payroll: DataFrame, rk: DataFrame, late_days: int = 5) -> DataFrame:
    """The join has no date key, so a participant's rows fan out; counts() gives the figures without
    that. Null ids are left out of both sides. Spark picks the strategy; large participants are split by
    the adaptive skew join."""
    p, r = _sides(payroll, rk)
    return _judged(p.join(r, "employee_id", "left"), late_days)


def exceptions(payroll: DataFrame, rk: DataFrame, late_days: int = 5) -> DataFrame:
    """The rows of detail() that are late or have no deposit. Deposits in time never leave the join."""
    p, r = _sides(payroll, rk)
    days = calendar_days(F.col("pay_date"), F.col("deposit_date"))
    wanted = p.join(r, (p["employee_id"] == r["employee_id"]) & ((days > late_days) | r["deposit_date"].isNull())).drop(r["employee_id"])
    alone = p.join(r.select("employee_id"), "employee_id", "left_anti")
    return _judged(wanted.unionByName(alone, allowMissingColumns=True), late_days)


def risk(missing: Column, late_rows: Column) -> Column:
    return F.when(missing > 0, "High").when(late_rows > 0, "Medium").otherwise("Low")


def counts(payroll: DataFrame, rk: DataFrame, late_days: int = 5) -> DataFrame:
    """What detail() has in all, in one row, without making its rows: total_rows, late_rows,
    missing_deposits, pairs (with both dates), total_days and max_days.

    A participant's rows are first counted by day, with map-side combining, so that however many they
    are, no more rows meet than there are days. Running sums from the latest day down then tell, for each
    pay date, how many deposits came later (and later than late_days) and what their days add up to."""
    events = [
        side.filter("employee_id is not null").select(
            F.trim("employee_id").alias("employee_id"), F.datediff(date, F.lit("1970-01-01").cast("date")).alias("day"), F.lit(n).alias("pays"), F.lit(1 - n).alias("deposits")
        )
        for side, date, n in ((payroll, "pay_date", 1), (rk, "deposit_date", 0))
    ]
    by_day = events[0].union(events[1]).groupBy("employee_id", "day").agg(F.sum("pays").alias("pays"), F.sum("deposits").alias("deposits"))
    dated = F.when(F.col("day").isNotNull(), F.col("deposits")).otherwise(F.lit(0).cast("long"))
    later = Window.partitionBy("employee_id").orderBy(F.desc("day"))
    # No deposit is more than -1 days after pay: days are cut at 0.
    after = lambda days: later.rangeBetween(Window.unboundedPreceding, -days)
    seen = by_day.withColumns({"dated": dated, "moments": dated * F.coalesce("day", F.lit(0))}).withColumns({
        "later": F.sum("dated").over(after(1)), "later_moments": F.sum("moments").over(after(1)),
        "late": F.sum("dated").over(after(late_days + 1) if late_days >= 0 else Window.partitionBy("employee_id")),
    })
    pays = F.when(F.col("day").isNotNull(), F.col("pays")).otherwise(F.lit(0).cast("long"))
    none = F.lit(0).cast("long")
    people = seen.groupBy("employee_id").agg(
        F.sum("pays").alias("n"), F.sum("deposits").alias("m"), F.sum(pays).alias("n_dated"), F.sum("dated").alias("m_dated"),
        F.sum(pays * F.coalesce("late", none)).alias("late_rows"),
        F.sum(pays * (F.coalesce("later_moments", none) - F.coalesce("later", none) * F.coalesce("day", none))).alias("days"),
        F.min(F.when(F.col("pays") > 0, F.col("day"))).alias("first_pay"), F.max(F.when(F.col("deposits") > 0, F.col("day"))).alias("last_deposit"),
    )
    total = lambda c, name: F.coalesce(F.sum(c), none).alias(name)
    return people.agg(
        total(F.col("n") * F.greatest("m", F.lit(1)), "total_rows"), total("late_rows", "late_rows"),
        total(F.col("n") * F.when(F.col("m") == 0, 1).otherwise(F.col("m") - F.col("m_dated")), "missing_deposits"),
        total(F.col("n_dated") * F.col("m_dated"), "pairs"), total("days", "total_days"),
        F.max(F.greatest(F.col("last_deposit") - F.col("first_pay"), F.when((F.col("n_dated") > 0) & (F.col("m_dated") > 0), F.lit(0)))).alias("max_days_"),
    ).withColumn("max_days", F.when(F.col("pairs") > 0, F.col("max_days_"))).drop("max_days_")


def summary(payroll: DataFrame, rk: DataFrame, late_days: int = 5) -> DataFrame:
    """total_rows, late_rows, missing_deposits and risk_level in one row."""
    counted = counts(payroll, rk, late_days).select("total_rows", "late_rows", "missing_deposits")
    return counted.withColumn("risk_level", risk(F.col("missing_deposits"), F.col("late_rows")))


def risk_with_drivers(payroll: DataFrame, rk: DataFrame, threshold: int = 5) -> DataFrame:
    """Rates of late and missing rows, lag statistics and a level from the rate: 5 % and 15 %."""
    mean = F.when(F.col("pairs") > 0, F.round(F.col("total_days") / F.col("pairs"), 6))
    counted = counts(payroll, rk, threshold).select("total_rows", "late_rows", "missing_deposits", "max_days", mean.alias("avg_days"))
    rate = (F.col("late_rows") + F.col("missing_deposits")) / F.greatest(F.col("total_rows"), F.lit(1))
    return counted.withColumn("exception_rate", F.round(rate, 6)).withColumn(
        "rate_risk", F.when(rate <= 0.05, "Low").when(rate <= 0.15, "Medium").otherwise("High")
    ).withColumn(
        "lag_risk", F.when(F.col("max_days") > threshold + 10, "High").when(F.col("max_days") > threshold + 3, "Medium").otherwise("Low")
    )
