"""Made-up plans of any size: payroll and recordkeeper extracts with stated shares of late, missing and
differing deposits, for tests and trials.

Every value is a hash of the seed, the column's name and the row's keys, cut to a number between 0 and
1. A row so depends on its own number only: any partitioning, any order and any retry give the same
rows, and nothing is drawn on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.functions.scalar import MONEY, business_days_after


@dataclass(frozen=True)
class Size:
    """hot_share is the share of all rows that are one participant's."""

    participants: int
    periods: int
    start: str = "2025-01-03"
    seed: int = 42
    hot_share: float = 0.0


class Draw:
    """Numbers between 0 and 1 by name, one for each value of the keys."""

    def __init__(self, seed: int, *keys: str) -> None:
        self.seed, self.keys = seed, keys

    def __call__(self, name: str) -> Column:
        bits = F.xxhash64(F.lit(self.seed), F.lit(name), *[F.col(k) for k in self.keys])
        return F.shiftrightunsigned(bits, 11) / F.lit(float(1 << 53))

    def between(self, name: str, low: float, high: float) -> Column:
        return F.lit(low) + self(name) * (high - low)

    def whole(self, name: str, low: int, high: int) -> Column:
        """A whole number from low to high, both included."""
        return (F.lit(low) + F.floor(self(name) * (high - low + 1))).cast("int")

    def chance(self, name: str, share: float) -> Column:
        return self(name) < share

    def one_of(self, name: str, values: Sequence, shares: Sequence[float] | None = None) -> Column:
        """One of the values, each with its share (equal ones, if none are given)."""
        upto = list(accumulate(shares or [1 / len(values)] * len(values)))
        u = self(name)
        return F.coalesce(*[F.when(u < top, F.lit(value)) for value, top in zip(values, upto[:-1], strict=False)], F.lit(values[-1]))


def _money(c: Column) -> Column:
    return F.round(c, 2).cast(MONEY)


def _rows(spark: SparkSession, size: Size) -> tuple[DataFrame, Draw, Draw]:
    """One row a participant and period (row, person, period, pay_date), and draws by row and by person."""
    rows = spark.range(size.participants * size.periods).withColumnRenamed("id", "row")
    by_row, by_person = Draw(size.seed, "row"), Draw(size.seed, "person")
    own = F.expr(f"row div {size.periods}")
    person = F.when(by_row.chance("hot", size.hot_share), F.lit(0).cast("long")).otherwise(own) if size.hot_share else own
    period = (F.col("row") % size.periods).cast("int")
    return rows.withColumns({"person": person, "period": period}).withColumn("pay_date", F.date_add(F.lit(size.start).cast("date"), F.col("period") * 14)), by_row, by_person


def synthetic_plan(spark: SparkSession, size: Size = Size(400, 6), differing: float = 0.10) -> tuple[DataFrame, DataFrame]:
    """A payroll provider's and a recordkeeper's extract. Deposits follow pay by 1 to 3 business days (70
    % of rows), 4 to 5 (25 %) or 6 to 10 (5 %); the share `differing` of rows is 2 or 5 % off."""
    rows, d, person = _rows(spark, size)
    percent = lambda name, values, shares: person.one_of(name, values, shares) / 100
    loan = F.when(person.chance("has_loan", 0.2), person.whole("loan", 600, 3_600)).otherwise(F.lit(0)) / 26
    rows = rows.withColumn("gross", person.whole("salary", 40_000, 160_000) / 26 + d.between("wages", -50, 50)).withColumns({
        "pretax": _money(F.col("gross") * percent("pretax", [0, 3, 5, 6, 8, 10], [0.15, 0.25, 0.30, 0.20, 0.05, 0.05])),
        "roth": _money(F.col("gross") * percent("roth", [0, 2, 4], [0.6, 0.25, 0.15])),
        "after": _money(F.col("gross") * percent("after", [0, 2], [0.8, 0.2])), "loan": _money(loan),
    }).withColumn("match", F.least(F.col("pretax") + F.col("roth") + F.col("after"), _money(F.col("gross") * 0.05)).cast(MONEY))
    payroll = rows.select(
        (F.col("person") + 100_001).alias("EmpNumber"), F.col("pay_date").alias("Payroll_Run_Date"), F.col("pretax").alias("PreTax_Defl"), F.col("roth").alias("Roth_Defl"),
        F.col("after").alias("AfterTax_Defl"), F.col("loan").alias("Loan_Pmt"), _money(F.col("gross")).alias("Gross_Wages"), F.col("match").alias("Match_5pct"),
        F.lit("REG").alias("Paygroup"), d.one_of("place", ["ATL", "SAV", "PHX", "DEN"]).alias("LocationCode"), F.lit(0).alias("Is_Offcycle"),
        F.lit(0).alias("Is_Prior_Period_Adj"), d.whole("service", 0, 10).alias("Years_of_Service"),
    )
    kind = d("lag")
    lag = F.when(kind < 0.70, d.whole("usual", 1, 3)).when(kind < 0.95, d.whole("slow", 4, 5)).otherwise(d.whole("late", 6, 10))
    factor = F.when(d.chance("differs", differing), d.one_of("factor", [1.02, 0.98, 1.05, 0.95])).otherwise(F.lit(1.0))
    kept = rows.withColumns({"post": business_days_after(F.col("pay_date"), lag), "factor": factor, "fund": d.one_of("fund", ["Target 2050", "Target 2040", "US Equity", "Intl Equity", "Stable Value"])})
    kept = kept.withColumns({c: _money(F.col(c) * F.col("factor")) for c in ("pretax", "roth", "after", "loan")})
    source = lambda c, text: F.when(F.col(c) > 0, F.lit(text)).otherwise(F.lit(""))
    rk = kept.select(
        (F.col("person") + 100_001).alias("Part_ID"), F.col("post").alias("Post_Date"), F.col("pretax").alias("EE_PreTax"), F.col("roth").alias("EE_Roth"),
        F.col("after").alias("EE_AfterTax"), F.col("loan").alias("Loan_Contr"), F.col("match").alias("ER_Match"), source("pretax", "EE PreTax").alias("Source_PreTax"),
        source("roth", "EE Roth").alias("Source_Roth"), source("after", "EE AfterTax").alias("Source_AfterTax"), source("loan", "Loan").alias("Source_Loan"), F.col("fund").alias("Fund"),
    )
    return payroll, rk


def _demo(rows: DataFrame, *extra: str) -> tuple[DataFrame, DataFrame]:
    """The demos' columns; rows without a deposit stay out of the recordkeeper's side."""
    person = F.concat(F.lit("E"), (F.col("person") + 1_000).cast("string")).alias("employee_id")
    amounts = [F.col("pretax").alias("def_amount"), F.col("roth").alias("roth_amount"), F.lit(0).cast(MONEY).alias("loan_amount")]
    payroll = rows.select(person, *extra, "pay_date", *amounts, F.col("pretax").alias("deferral_pre"), F.col("roth").alias("deferral_roth"))
    rk = rows.filter("lag is not null").select(
        person, F.date_add("pay_date", F.col("lag")).alias("record_date"), F.col("rk_pretax").alias("def_amount"), F.col("roth").alias("roth_amount"), F.lit(0).cast(MONEY).alias("loan_amount")
    )
    return payroll, rk


def clean_plan(spark: SparkSession, size: Size = Size(40, 6)) -> tuple[DataFrame, DataFrame]:
    """Everything arrives, in full, within three days."""
    rows, d, _ = _rows(spark, size)
    rows = rows.withColumns({"pretax": _money(d.between("amount", 50, 200)), "roth": F.lit(0).cast(MONEY), "lag": d.whole("lag", 1, 3)})
    return _demo(rows.withColumn("rk_pretax", F.col("pretax")))


def messy_plan(spark: SparkSession, size: Size = Size(80, 8), missing: float = 0.12, differing: float = 0.22, late: float = 0.18) -> tuple[DataFrame, DataFrame]:
    """Shares of rows without a deposit and, among those with one, of amounts that differ by up to 25 and
    of deposits 6 to 12 days after pay (others: 1 to 4)."""
    rows, d, _ = _rows(spark, size)
    rows = rows.withColumn("pretax", _money(d.between("amount", 40, 220)))
    off = F.when(d.chance("differs", differing), _money(d.between("off", -25, 25))).otherwise(F.lit(0).cast(MONEY))
    lag = F.when(d.chance("late", late), d.whole("days_late", 6, 12)).otherwise(d.whole("days", 1, 4))
    return _demo(rows.withColumns({
        "roth": _money(F.col("pretax") * d.between("roth", 0.0, 0.15)), "rk_pretax": F.greatest(F.lit(0).cast(MONEY), (F.col("pretax") + off).cast(MONEY)),
        "lag": F.when(~d.chance("missing", missing), lag),
    }))


def catch_up_plan(spark: SparkSession, size: Size = Size(60, 8), hce: float = 0.35) -> tuple[DataFrame, DataFrame]:
    """Highly compensated participants of 50 or more pay catch-up amounts before tax and nothing as Roth;
    others pay some Roth in two of five rows. Deposits mirror pay two days on."""
    rows, d, person = _rows(spark, size)
    rows = rows.withColumns({"age": person.one_of("age", [35, 42, 48, 50, 55, 60]), "is_hce": person.chance("hce", hce).cast("int"), "base": _money(d.between("base", 40, 190))})
    hit, some_roth = (F.col("is_hce") == 1) & (F.col("age") >= 50), d.chance("uses_roth", 0.4)
    pretax = F.when(hit, F.col("base") + _money(d.between("catchup", 120, 320))).when(some_roth, _money(F.col("base") * d.between("pretax", 0.5, 0.9))).otherwise(F.col("base"))
    roth = F.when(~hit & some_roth, _money(F.col("base") * d.between("roth", 0.2, 0.6))).otherwise(F.lit(0).cast(MONEY))
    rows = rows.withColumns({"pretax": pretax.cast(MONEY), "roth": roth, "lag": F.lit(2)})
    return _demo(rows.withColumn("rk_pretax", F.col("pretax")), "age", "is_hce")
