"""The gate before a run: mapping contract, headers, join-key coverage."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions.headers import key

AMOUNTS = ("EE Deferral $", "EE Roth $", "loan_amount", "pretax", "roth", "loan", "amount")


def coverage(rows: DataFrame, id_column: str = "employee_id") -> DataFrame:
    """Rows, rows with an id that is neither null nor blank, and their share in per cent."""
    filled = F.coalesce(F.trim(F.col(id_column).cast("string")) != "", F.lit(False))
    one = rows.select(filled.alias("filled")).agg(F.count(F.lit(1)).alias("total_rows"), F.count_if("filled").alias("rows_with_id"))
    share = F.when(F.col("total_rows") > 0, F.col("rows_with_id") * 100.0 / F.col("total_rows")).otherwise(0.0)
    return one.withColumn("coverage_pct", F.round(share, 4))


def mapped_headers(columns: list[str], fields: dict) -> tuple[dict[str, str], list[str]]:
    """Canonical name to header, by the examples of a mapping side, and the fields without one."""
    there = {key(c): c for c in columns}
    found, missing = {}, []
    for name, spec in fields.items():
        canonical = spec.get("canonical", name)
        header = next((there[key(e)] for e in [*spec.get("examples", []), canonical] if key(e) in there), None)
        if header is None:
            missing.append(canonical)
        else:
            found[canonical] = header
    return found, missing


@dataclass
class Report:
    safe: bool = True
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    coverage: dict[str, float] = field(default_factory=dict)
    mapped: dict[str, dict[str, str]] = field(default_factory=dict)

    def block(self, text: str) -> None:
        self.safe = False
        self.errors.append(text)

    def lines(self) -> list[str]:
        """The report as text."""
        out = [f"Preflight: {'SAFE TO RUN' if self.safe else 'BLOCKED'}"]
        out += [f"  error: {e}" for e in self.errors] + [f"  warning: {w}" for w in self.warnings]
        return out + [f"  {k} id coverage: {v:.1f}%" for k, v in self.coverage.items()]


def run(payroll: DataFrame, rk: DataFrame, mapping: dict, least_coverage: float = 95.0) -> Report:
    """Every mapped field must have a header, both sides an id and an amount; then one pruned job a
    side counts ids. Missing dates and low coverage warn, empty tables block."""
    report = Report()
    for side, df, date in (("payroll", payroll, "pay_date"), ("recordkeeper", rk, "deposit_date")):
        found, missing = mapped_headers(df.columns, mapping.get(side) or {})
        report.mapped[side] = found
        for name in missing:
            report.block(f"{side}: no header for {name}")
        if "employee_id" not in found:
            report.block(f"{side}: employee_id is not mapped")
        if not any(a in found for a in AMOUNTS):
            report.block(f"{side}: no amount is mapped")
        if date not in found:
            report.warnings.append(f"{side}: {date} is not mapped; lags cannot be computed")
        if "employee_id" in found:
            total, _, share = coverage(df, found["employee_id"]).first()
            report.coverage[side] = share
            if not total:
                report.block(f"{side}: no rows")
            elif share < least_coverage:
                report.warnings.append(f"{side}: only {share:.1f}% of rows have an id")
    return report
