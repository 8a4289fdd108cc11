"""Issue metadata, the union of all issues, and the plan-health score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.functions.fixed import DEFAULT_ISSUE, ISSUES, SOURCE_CATEGORY, WEIGHTS
from ledgerlane.functions.scalar import dollars

METADATA = ("issue_category", "severity", "correction_hint")


def taxonomy(spark: SparkSession) -> DataFrame:
    """The issue types as a table of a few rows."""
    rows = [(k, *v) for k, v in ISSUES.items()]
    return spark.createDataFrame(rows, "issue_type string, issue_category string, severity string, correction_hint string")


def with_metadata(rows: DataFrame, by: str = "issue_type") -> DataFrame:
    """rows with category, severity and hint of their issue type; a fixed table, so a lookup map."""
    out = {}
    for k, name in enumerate(METADATA):
        known = F.create_map(*[F.lit(x) for issue, v in ISSUES.items() for x in (issue, v[k])])
        out[name] = F.coalesce(F.try_element_at(known, F.col(by)), F.lit(DEFAULT_ISSUE[k]))
    return rows.withColumns(out)


def _details(source: str) -> Column:
    """A sentence for a row of one source; parts without a value are left out."""
    part = lambda name, text: F.when(text.isNotNull(), F.concat(F.lit(f"{name}="), text))
    money = lambda c: part(c, F.when(F.col(c).isNotNull(), dollars(F.col(c))))
    over = lambda name, c: part(name, F.when(c > 0, dollars(c)))
    label, parts = {
        "secure20": ("Secure 2.0", lambda: [over("total_deferral", F.col("deferral_pretax") + F.col("deferral_roth")), over("catchup_amount", F.col("catchup_amount"))]),
        "eligibility": ("Eligibility", lambda: [
            part("eligibility", F.col("computed_eligibility_date").cast("string")), part("first_deferral", F.col("first_deferral_date").cast("string")),
            part("drift_days", F.col("drift_days").cast("string")),
        ]),
        "comp_402g": ("402(g)", lambda: [money("total_deferrals"), money("allowed_limit"), over("excess_amount", F.col("excess_amount"))]),
        "match": ("Match", lambda: [money("eligible_comp"), money("expected_match"), money("er_match_amount"), money("variance")]),
    }.get(source, (source, lambda: []))
    return F.concat(F.concat_ws(", ", F.concat(F.lit(f"{label} issue_type="), F.col("issue_type")), *parts()), F.lit("."))


def union_issues(sources: dict[str, DataFrame], run_id: str, plan_name: str | None, plan_year: int | None) -> DataFrame:
    """All sources' issues in one shape. Where a row lacks a field: the source's name as issue type,
    its category, severity Medium."""
    out = None
    for name, rows in sources.items():
        if "violation_type" in rows.columns:
            rows = rows.withColumnRenamed("violation_type", "issue_type")
        for column, default in (("issue_type", name), ("issue_category", SOURCE_CATEGORY.get(name, "Other")), ("severity", "Medium"), ("correction_hint", None)):
            value = F.col(column) if column in rows.columns else F.lit(None).cast("string")
            rows = rows.withColumn(column, F.coalesce(value, F.lit(default).cast("string")))
        one = rows.select(
            F.lit(run_id).alias("run_id"), F.lit(plan_name).cast("string").alias("plan_name"), F.lit(plan_year).cast("int").alias("plan_year"),
            "employee_id", "issue_category", "issue_type", "severity", F.lit(name).alias("source"), _details(name).alias("details"), "correction_hint",
        )
        out = one if out is None else out.unionByName(one)
    return out


def by_category(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_category").agg(F.count(F.lit(1)).alias("issues"))


def plan_health(issues: DataFrame, participants: DataFrame) -> DataFrame:
    """Score, grade and risk level from issues weighted by category against participants."""
    weights = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    weight = F.coalesce(F.try_element_at(weights, F.col("issue_category")), F.lit(WEIGHTS["Other"]))
    weighted = issues.agg(F.coalesce(F.sum(weight), F.lit(0)).cast("long").alias("weighted_violations"))
    people = participants.agg(F.greatest(F.count_distinct("employee_id"), F.lit(1)).cast("long").alias("total_participants"))
    exact = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - F.col("weighted_violations") / F.col("total_participants") * 100.0))
    grade = F.when(exact >= 90, "A").when(exact >= 80, "B").when(exact >= 70, "C").when(exact >= 60, "D").otherwise("F")
    risk = F.when(exact >= 85, "Low").when(exact >= 70, "Moderate").otherwise("High")
    one = weighted.withColumn("k", F.lit(0)).join(people.withColumn("k", F.lit(0)), "k").drop("k")  # a row each
    return one.withColumns({"score": F.bround(exact, 1), "grade": grade, "risk_level": risk})
