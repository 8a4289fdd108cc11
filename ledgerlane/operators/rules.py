"""Compliance rules; each is a projection, filter or one roll-up, in column expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions.fixed import CATCHUP_DEMO_REASON, FIXES, LIMITS
from ledgerlane.functions.scalar import age_on, age_rounded, first_of_month, once, ratio, years_after
from ledgerlane.operators.issues import with_metadata

HCE_ROTH, MISCODED = "HCE catch-up not coded as Roth", "Potential catch-up coded in base deferral source"
NO_START, LATE_START = "No contributions after eligibility", "Late start after eligibility"


def _fix(issue: Column) -> Column:
    known = [F.when(issue == k, F.lit(v)) for k, v in FIXES.items()]
    return F.coalesce(*known)


def secure20(rows: DataFrame) -> DataFrame:
    """Two disjoint catch-up rules over rows with employee_id, is_hce, pretax, roth, catchup_pretax,
    catchup_roth, and age, dob with pay_date, or both: a row without an age gets that of its dob."""
    ages = [F.col("age").try_cast("int")] if "age" in rows.columns else []
    ages += [age_on(F.col("dob"), F.col("pay_date"))] if "dob" in rows.columns else []
    rows = rows.withColumn("age", F.coalesce(*ages, F.lit(-1)).cast("int")).withColumn("catchup_amount", F.col("catchup_pretax") + F.col("catchup_roth"))
    kind = F.when(
        F.col("is_hce") & (F.col("age") >= 50) & (F.col("catchup_pretax") > 0) & (F.col("catchup_roth") == 0), HCE_ROTH
    ).when((F.col("age") >= 50) & (F.col("catchup_amount") == 0), MISCODED)
    found = rows.withColumn("violation_type", once(kind)).filter("violation_type is not null").select(
        "employee_id", "age", "is_hce", F.col("pretax").alias("deferral_pretax"), F.col("roth").alias("deferral_roth"), "catchup_amount",
        "violation_type", _fix(F.col("violation_type")).alias("recommended_fix"),
    )
    return with_metadata(found, "violation_type")


def secure20_summary(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count(F.lit(1)).alias("total_violations"), F.count_if(F.col("violation_type") == HCE_ROTH).alias("hce_violation_count"),
        F.count_if(F.col("violation_type") == MISCODED).alias("potential_catchup_miscode_count"),
    )


def secure20_demo(rows: DataFrame) -> DataFrame:
    """HCE, 50 or older, pre-tax deferrals and no Roth, on base deferrals."""
    hit = F.col("is_hce") & (F.col("age") >= 50) & (F.col("pretax") > 0) & (F.col("roth") == 0)
    return rows.filter(hit).select(
        "employee_id", "age", "is_hce", F.col("pretax").alias("pretax_amount"), F.col("roth").alias("roth_amount"),
        F.lit(CATCHUP_DEMO_REASON).alias("reason"),
    )


def post_termination(rows: DataFrame, grace_days: int = 0) -> DataFrame:
    """Contributions paid more than grace_days after termination."""
    days = F.datediff("pay_date", "termination_date")
    total = F.col("pretax") + F.col("roth")
    return rows.filter(F.col("termination_date").isNotNull() & (days > grace_days) & (total > 0)).select(
        "employee_id", "employment_status", "termination_date", "pay_date", days.alias("days_after_termination"),
        F.col("pretax").alias("def_amount"), F.col("roth").alias("roth_amount"), total.alias("total_contribution"),
    )


@dataclass(frozen=True)
class EligibilityRule:
    """immediate, age21_and_1year, service_only, age_only; anything else is 365 days and age 21."""

    kind: str = "age21_and_1year"
    service_days: int | None = None
    age: int | None = None
    align_first_month: bool = False

    def date(self) -> Column:
        hire, dob = F.col("hire_date"), F.col("dob")
        if self.kind == "immediate":
            d = hire
        elif self.kind == "service_only":
            d = F.date_add(hire, self.service_days or 0)
        elif self.kind == "age_only":
            d = years_after(dob, self.age or 21)
        else:
            own = self.kind == "age21_and_1year"
            days, age = (self.service_days or 365, self.age or 21) if own else (365, 21)
            d = F.greatest(F.date_add(hire, days), years_after(dob, age))
        return first_of_month(d) if self.align_first_month else d


def eligibility_dates(census: DataFrame, contributions: DataFrame) -> DataFrame:
    """Per participant: smallest hire_date and dob, and first pay_date with a positive contribution."""
    people = census.filter("employee_id is not null").groupBy("employee_id").agg(F.min("hire_date").alias("hire_date"), F.min("dob").alias("dob"))
    first = contributions.filter("employee_id is not null").groupBy("employee_id").agg(
        F.min(F.when(F.col("pretax") + F.col("roth") > 0, F.col("pay_date"))).alias("first_deferral_date")
    )
    return people.join(first, "employee_id", "left")


def eligibility_drift(dates: DataFrame, rule: EligibilityRule, grace_days: int = 30) -> DataFrame:
    """Participants without contributions, or whose first came more than grace_days after eligibility."""
    rows = dates.withColumn("computed_eligibility_date", once(rule.date()))
    first, due = F.col("first_deferral_date"), F.col("computed_eligibility_date")
    issue = F.when(due.isNull(), None).when(first.isNull(), NO_START).when(first > F.date_add(due, grace_days), LATE_START)
    found = rows.withColumn("issue_type", once(issue)).filter("issue_type is not null").select(
        "employee_id", "hire_date", "dob", age_rounded(F.col("dob"), due).alias("age_at_eligibility"), "computed_eligibility_date",
        "first_deferral_date", F.datediff(first, due).alias("drift_days"), "issue_type", _fix(F.col("issue_type")).alias("recommended_fix"),
    )
    return with_metadata(found)


def _limit(year: Column, which: int, limits: dict[int, tuple[int, int]]) -> Column:
    """The limit of a year; years without one use the latest."""
    known = [F.when(year == y, F.lit(v[which])) for y, v in limits.items()]
    return F.coalesce(*known, F.lit(limits[max(limits)][which])).cast("decimal(18,2)")


def deferral_totals(rows: DataFrame, plan_year: int | None = None, limits: dict[int, tuple[int, int]] = LIMITS) -> DataFrame:
    """Per participant and year: base and catch-up totals, greatest age, limits (by year: base and
    catch-up) and excess."""
    dated = rows.filter("employee_id is not null and pay_date is not null").withColumn("plan_year", F.year("pay_date"))
    if plan_year is not None:
        dated = dated.filter(F.col("plan_year") == plan_year)
    age = F.max("age") if "age" in rows.columns else F.lit(None).cast("int")
    totals = dated.groupBy("employee_id", "plan_year").agg(
        F.sum(F.col("pretax") + F.col("roth")).alias("total_base_deferrals"),
        F.sum(F.col("catchup_pretax") + F.col("catchup_roth")).alias("total_catchup_deferrals"), age.alias("age"),
    )
    year, money = F.col("plan_year"), lambda c: c.cast("decimal(18,2)")
    eligible = F.coalesce(F.col("age") >= 50, F.lit(False)) | (F.col("total_catchup_deferrals") > 0)
    totals = totals.withColumns({
        "total_deferrals": money(F.col("total_base_deferrals") + F.col("total_catchup_deferrals")), "is_catchup_eligible": eligible,
        "base_limit": _limit(year, 0, limits), "catchup_limit": _limit(year, 1, limits),
    })
    allowed = money(F.col("base_limit") + F.when(F.col("is_catchup_eligible"), F.col("catchup_limit")).otherwise(F.lit(0)))
    return totals.withColumn("allowed_limit", allowed).withColumn(
        "excess_amount", F.greatest(money(F.col("total_deferrals") - F.col("allowed_limit")), F.lit(0).cast("decimal(18,2)"))
    )


def deferral_excess(totals: DataFrame) -> DataFrame:
    found = totals.filter("excess_amount > 0").withColumn("issue_type", F.lit("402(g) excess deferrals")).drop("age")
    return with_metadata(found)


@dataclass(frozen=True)
class MatchRule:
    cap: float = 0.06
    rate: float = 0.50
    tolerance: float = 5.0
    tolerance_pct: float = 0.15


def match_check(rows: DataFrame, rule: MatchRule = MatchRule()) -> DataFrame:
    """Employer match against compensation x min(deferral share, cap) x rate, in doubles. Amounts are
    converted once and rows classified once, whatever reads the result."""
    amounts = F.struct(*[F.col(c).cast("double").alias(k) for c, k in (("compensation", "comp"), ("deferral", "paid"), ("er_match", "match"))])
    rows = rows.filter("compensation > 0").select("employee_id", "pay_date", once(amounts).alias("a"))
    share = F.col("a.paid") / F.col("a.comp")
    rows = rows.withColumns({"share": share, "expected": F.col("a.comp") * F.least(share, F.lit(rule.cap)) * rule.rate})
    gap = F.col("a.match") - F.col("expected")
    within = (F.abs(gap) <= rule.tolerance) & (F.abs(ratio(gap, F.col("expected"))) <= rule.tolerance_pct)
    kind = F.when(~within & (gap < 0), "Under-match").when(~within & (gap > 0), "Over-match")
    told = F.struct("share", "expected", gap.alias("gap"), ratio(gap, F.col("expected")).alias("ratio"), kind.alias("kind"))
    found = rows.select("employee_id", "pay_date", "a", once(told).alias("m")).filter("m.kind is not null").select(
        "employee_id", "pay_date", F.col("a.comp").alias("eligible_comp"), F.col("a.paid").alias("ee_deferral_amount"), F.col("m.share").alias("deferral_pct"),
        F.col("a.match").alias("er_match_amount"), F.col("m.expected").alias("expected_match"), F.col("m.gap").alias("variance"),
        F.col("m.ratio").alias("variance_pct"), F.col("m.kind").alias("issue_type"),
    )
    return with_metadata(found)


def match_summary(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count(F.lit(1)).alias("total_issues"), F.count_if(F.col("issue_type") == "Under-match").alias("under_match_count"),
        F.count_if(F.col("issue_type") == "Over-match").alias("over_match_count"),
    )
