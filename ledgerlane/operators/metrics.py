"""One-row and few-row summaries, each a single conditional aggregate over the joined frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions.fixed import METRICS
from ledgerlane.functions.scalar import business_days
from ledgerlane.operators.reconcile import BOTH, LEFT, RIGHT

_SIDES = {"deferrals": "deferral", "loans": "loan"}


def _flags(both: DataFrame, late_days: int) -> DataFrame:
    lag = business_days(F.col("pay_date"), F.col("deposit_date"))
    out = both.withColumn("lag", lag).withColumn("late", F.coalesce((F.col("merge_status") == BOTH) & (F.col("lag") > late_days), F.lit(False)))
    for name, amount in _SIDES.items():
        out = out.withColumn(f"mismatch_{name}", (F.col("merge_status") == BOTH) & (F.col(f"{amount}_payroll") != F.col(f"{amount}_rk")))
    return out


def run_totals(both: DataFrame) -> DataFrame:
    sums = [F.sum(f"{a}_{side}").alias(f"total_{s}_{side}") for s, a in _SIDES.items() for side in ("payroll", "rk")]
    return both.agg(*sums)


def mismatch_counts(both: DataFrame, late_days: int = 5) -> DataFrame:
    return _flags(both, late_days).agg(
        F.count_if("mismatch_deferrals").alias("deferral_mismatch_count"), F.count_if("mismatch_loans").alias("loan_mismatch_count"),
        F.count_if(F.col("merge_status") == LEFT).alias("only_payroll_count"), F.count_if(F.col("merge_status") == RIGHT).alias("only_rk_count"),
        F.count_if("late").alias("late_deferral_count"), F.count_if("late").alias("late_loan_count"),
    )


def _long(one_row: DataFrame, names: list[str], rows: list[tuple]) -> DataFrame:
    """A row for each (label, ..., column) of a one-row frame."""
    entries = [F.struct(*[F.lit(x).alias(n) for n, x in zip(names, row[:-1], strict=True)], row[-1].alias("value")) for row in rows]
    return one_row.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def summary_counts(both: DataFrame, late_days: int = 5) -> DataFrame:
    """Rows by stream and category."""
    one = mismatch_counts(both, late_days)
    category = {"only_in_payroll": "only_payroll_count", "only_in_recordkeeper": "only_rk_count"}
    rows = []
    for s, a in _SIDES.items():
        own = category | {"mismatches": f"{a}_mismatch_count", "late": f"late_{a}_count"}
        rows += [(s, k, F.col(c)) for k, c in own.items()]
    return _long(one, ["stream", "category"], rows).withColumnRenamed("value", "rows")


def compliance_metrics(both: DataFrame, late_days: int = 5) -> DataFrame:
    """Twelve rows: category, metric, value, notes. Lag figures are over late rows of both streams. The
    joined frame has one row a participant, so that counting rows counts participants."""
    flags = _flags(both, late_days)
    one = flags.agg(
        F.count_if("late").alias("late"),
        F.max(F.when(F.col("late"), F.col("lag"))).alias("max_lag"), F.avg(F.when(F.col("late"), F.col("lag"))).alias("avg_lag"),
        F.count_if("mismatch_deferrals").alias("mis_d"), F.count_if("mismatch_loans").alias("mis_l"),
        F.count_if(F.col("mismatch_deferrals") | F.col("mismatch_loans")).alias("mis_people"),
        F.count_if(F.col("merge_status") == LEFT).alias("left"), F.count_if(F.col("merge_status") == RIGHT).alias("right"),
    )
    v = lambda c: F.col(c).cast("double")
    values = [v("late"), v("late"), v("late"), v("max_lag"), F.bround("avg_lag", 2), v("mis_d"), v("mis_l"), v("mis_people"), v("left"), v("right"), v("left"), v("right")]
    return _long(one, ["category", "metric", "notes"], [(*told, value) for told, value in zip(METRICS, values, strict=True)])


def inferred_plan_year(payroll: DataFrame) -> DataFrame:
    return payroll.agg(F.max(F.year("pay_date")).alias("plan_year"))


def run_risk(missing: Column, late: Column, deferral: Column, loan: Column) -> Column:
    """Risk of a run: any missing deposit, else any late row or mismatch."""
    return F.when(missing > 0, "High").when((late > 0) | (deferral > 0) | (loan > 0), "Medium").otherwise("Low")


def narrative_risk(late: Column, mismatches: Column) -> Column:
    return F.when(late > 0, "High").when(mismatches > 0, "Medium").otherwise("Low")


def batch_risk(deferral: Column, loan: Column, late: Column) -> Column:
    high = (deferral > 100) | (loan > 50) | (late > 50)
    return F.when(high, "High").when((deferral > 10) | (loan > 5) | (late > 10), "Medium").otherwise("Low")


def history_risk(total: Column) -> Column:
    return F.when(total == 0, "Low").when(total <= 20, "Medium").otherwise("High")


def risk_levels(both: DataFrame, timing: DataFrame) -> DataFrame:
    """The run-, narrative- and batch-level risk of one run, from its counts."""
    one = mismatch_counts(both).withColumn("k", F.lit(0)).join(timing.withColumn("k", F.lit(0)), "k").drop("k")
    d, ln, late = F.col("deferral_mismatch_count"), F.col("loan_mismatch_count"), F.col("late_deferral_count")
    return one.select(
        run_risk(F.col("missing_deposits"), F.greatest(F.col("late_rows"), late), d, ln).alias("run_risk"),
        narrative_risk(late, d + ln).alias("narrative_risk"), batch_risk(d, ln, late).alias("batch_risk"),
    )


def batch_dashboard(payroll: DataFrame, rk: DataFrame, late_days: int = 5) -> DataFrame:
    """One row per batch_id for all batches in one job: totals, counts and risk."""

    def side(rows: DataFrame, date: str, tag: str) -> DataFrame:
        return rows.filter("employee_id is not null").groupBy("batch_id", "employee_id").agg(
            F.sum(F.col("pretax") + F.col("roth")).alias(f"deferral_{tag}"), F.sum("loan").alias(f"loan_{tag}"), F.min(date).alias(date)
        ).withColumn(f"in_{tag}", F.lit(True))

    both = side(payroll, "pay_date", "payroll").join(side(rk, "deposit_date", "rk"), ["batch_id", "employee_id"], "full_outer")
    both = both.withColumn("merge_status", F.when(F.col("in_payroll") & F.col("in_rk"), BOTH).when(F.col("in_payroll"), LEFT).otherwise(RIGHT))
    out = _flags(both, late_days).groupBy("batch_id").agg(
        F.sum("deferral_payroll").alias("deferrals_payroll"), F.sum("deferral_rk").alias("deferrals_rk"),
        F.count_if("mismatch_deferrals").alias("deferral_mismatches"), F.count_if("mismatch_loans").alias("loan_mismatches"),
        F.count_if("late").alias("late_deferrals"),
    )
    return out.withColumn("risk", batch_risk(F.col("deferral_mismatches"), F.col("loan_mismatches"), F.col("late_deferrals")))


def batch_overview(batches: DataFrame, payroll: DataFrame, rk: DataFrame, late_days: int = 5) -> DataFrame:
    """Every one of batches(run_no, batch_id, plan_name, payroll_file, rk_file, payroll_vendor,
    rk_vendor, evidence_pack) with its totals, counts and risk; a batch without rows has zeros."""
    figures = batch_dashboard(payroll, rk, late_days).drop("risk")
    known = {"payroll_vendor": "Unknown", "rk_vendor": "Unknown", "evidence_pack": "N/A"}
    counts = ["deferral_mismatches", "loan_mismatches", "late_deferrals"]
    out = batches.join(figures, "batch_id", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast(out.schema[c].dataType)) for c in ("deferrals_payroll", "deferrals_rk", *counts)}
    out = out.withColumns(zero | {c: F.coalesce(c, F.lit(v)) for c, v in known.items()})
    return out.select(*batches.columns, *zero, batch_risk(*[F.col(c) for c in counts]).alias("risk"))


def run_history(runs: DataFrame) -> DataFrame:
    total = F.col("deferral_mismatch_count") + F.col("loan_mismatch_count") + F.col("late_deferral_count")
    return runs.select(
        "id", "created_at", "status", "plan_name", "payroll_filename", "rk_filename", "deferral_mismatch_count", "loan_mismatch_count", "late_deferral_count",
        total.alias("total_issues"), history_risk(total).alias("risk"),
    )


def recent_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    """The newest runs (1 to 200), ties by id."""
    return runs.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(200, limit)))


def sample_ids(rows: DataFrame, n: int = 3) -> DataFrame:
    return rows.select("employee_id").distinct().orderBy("employee_id").limit(n)


def narrative(both: DataFrame, timing: DataFrame, ids: DataFrame) -> DataFrame:
    """One sentence on a run, from one-row frames; ids holds a few example ids."""
    counts = mismatch_counts(both).withColumn("k", F.lit(0))
    listed = ids.agg(F.array_join(F.array_sort(F.collect_list("employee_id")), ", ").alias("ids")).withColumn("k", F.lit(0))
    one = counts.join(timing.withColumn("k", F.lit(0)), "k").join(listed, "k")
    d, ln, late = F.col("deferral_mismatch_count"), F.col("loan_mismatch_count"), F.col("late_deferral_count")
    risk = run_risk(F.col("missing_deposits"), F.greatest(F.col("late_rows"), late), d, ln)
    text = F.concat_ws(
        "; ",
        F.format_string("%d deferral and %d loan amounts differ between payroll and recordkeeper", d, ln),
        F.when(late > 0, F.format_string("%d participants were paid in late", late)).otherwise(F.lit("no deposit was late")),
        F.when(F.col("ids") != "", F.format_string("differing deferrals include participants %s", F.col("ids"))),
        F.format_string("risk of this run: %s", risk),
    )
    return one.select(F.concat(text, F.lit(".")).alias("narrative"))
