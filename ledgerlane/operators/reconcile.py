"""Reconciliation of payroll and recordkeeper: one roll-up a side, one full outer join, both streams.

Sides are DataFrames with employee_id, pay_date or deposit_date, pretax, roth, loan (money), and
optionally first_name, last_name. Null ids are left out; amounts are decimals, so sums compare exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions.scalar import business_days

STREAMS = {"deferrals": "deferral", "loans": "loan"}
BOTH, LEFT, RIGHT = "both", "left_only", "right_only"


def roll_up(side: DataFrame, date: str) -> DataFrame:
    """One row per participant: sums of both streams, earliest date, names (their smallest value)."""
    names = [F.min(c).alias(c) for c in ("first_name", "last_name") if c in side.columns]
    return side.filter(F.col("employee_id").isNotNull()).groupBy("employee_id").agg(
        F.sum(F.col("pretax") + F.col("roth")).alias("deferral"), F.sum("loan").alias("loan"), F.min(date).alias(date), *names
    )


def joined(payroll: DataFrame, rk: DataFrame) -> DataFrame:
    """Both sides' roll-ups in one full outer join, with both streams' amounts and the merge status.
    Every query on either stream projects this frame."""
    p, r = roll_up(payroll, "pay_date"), roll_up(rk, "deposit_date").drop("first_name", "last_name")
    p = p.withColumnsRenamed({s: f"{s}_payroll" for s in STREAMS.values()}).withColumn("in_payroll", F.lit(True))
    r = r.withColumnsRenamed({s: f"{s}_rk" for s in STREAMS.values()}).withColumn("in_rk", F.lit(True))
    status = F.when(F.col("in_payroll") & F.col("in_rk"), BOTH).when(F.col("in_payroll"), LEFT).otherwise(RIGHT)
    return p.join(r, "employee_id", "full_outer").withColumn("merge_status", status).drop("in_payroll", "in_rk")


def stream(both: DataFrame, name: str) -> DataFrame:
    """One stream's rows with amounts, dates, status, delta (payroll - rk) and business-day lag."""
    amount = STREAMS[name]
    names = [c for c in ("first_name", "last_name") if c in both.columns]
    return both.select(
        "employee_id", F.col(f"{amount}_payroll").alias("amount_payroll"), "pay_date", *names,
        F.col(f"{amount}_rk").alias("amount_rk"), "deposit_date", "merge_status",
        F.when(F.col("merge_status") == BOTH, F.col(f"{amount}_payroll") - F.col(f"{amount}_rk")).alias("delta"),
        business_days(F.col("pay_date"), F.col("deposit_date")).alias("business_days_lag"),
    )


def row_level(payroll: DataFrame, rk: DataFrame) -> DataFrame:
    """The deferral stream without roll-up: every payroll row against every row of its participant."""
    p = payroll.filter("employee_id is not null").select("employee_id", "pay_date", (F.col("pretax") + F.col("roth")).alias("amount_payroll"))
    r = rk.filter("employee_id is not null").select("employee_id", "deposit_date", (F.col("pretax") + F.col("roth")).alias("amount_rk"))
    return p.withColumn("l", F.lit(True)).join(r.withColumn("r", F.lit(True)), "employee_id", "full_outer").select(
        "employee_id", "pay_date", "amount_payroll", "deposit_date", "amount_rk",
        F.when(F.col("l") & F.col("r"), BOTH).when(F.col("l"), LEFT).otherwise(RIGHT).alias("merge_status"),
    )


def differs(tolerance: float = 0.0) -> Column:
    """Amounts differ by more than tolerance; a missing amount counts as 0."""
    zero = F.lit(0).cast("decimal(18,2)")
    gap = F.abs(F.coalesce("amount_payroll", zero) - F.coalesce("amount_rk", zero))
    return (F.col("merge_status") == BOTH) & (gap > F.lit(tolerance).cast("decimal(18,2)"))


def mismatches(rows: DataFrame, tolerance: float = 0.0) -> DataFrame:
    return rows.filter(differs(tolerance))


def only_in(rows: DataFrame, status: str) -> DataFrame:
    return rows.filter(F.col("merge_status") == status)


def late(rows: DataFrame, days: int = 5) -> DataFrame:
    """Rows of both sides whose deposit came more than so many business days after pay."""
    return rows.filter((F.col("merge_status") == BOTH) & (F.col("business_days_lag") > days))
