"""Deposit timing over streams: payroll rows wait for deposits of their participant.

An extension of the batch operator: a left outer stream-stream join, bounded by watermarks and a range
of days, so state is dropped once a payroll row can no longer be matched; it then comes out as missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions.scalar import calendar_days


def deposit_timing(payroll: DataFrame, deposits: DataFrame, wait_days: int = 30, late_days: int = 5, delay: str = "1 day") -> DataFrame:
    """payroll(employee_id, pay_date, ...) with deposit_date, days_to_deposit, is_late, missing_deposit;
    a row per deposit within wait_days. Works on streams (append mode) and on tables alike."""
    p = payroll.filter("employee_id is not null").withColumn("pay_time", F.col("pay_date").cast("timestamp")).withWatermark("pay_time", delay)
    d = deposits.filter("employee_id is not null").select(
        F.col("employee_id").alias("deposit_for"), "deposit_date", F.col("deposit_date").cast("timestamp").alias("deposit_time")
    ).withWatermark("deposit_time", delay)
    near = F.expr(f"employee_id = deposit_for and deposit_time >= pay_time and deposit_time <= pay_time + interval {wait_days} days")
    days = calendar_days(F.col("pay_date"), F.col("deposit_date"))
    return p.join(d, near, "left_outer").withColumns({
        "days_to_deposit": days, "is_late": F.coalesce(days > late_days, F.lit(False)), "missing_deposit": F.col("deposit_date").isNull(),
    }).drop("deposit_for", "pay_time", "deposit_time")
