"""A whole run: two sides in, lazy tables and a summary out, and on request files, manifest and ZIP."""

from __future__ import annotations

import argparse
import json
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlane.functions import fixed
from ledgerlane.operators import integrity, issues, metrics, preflight, reconcile, rules, timing
from ledgerlane.sources import catalogue, files, sinks, storage, workbook


#: Tables of a few rows whatever the input: one file each.
FEW_ROWS = ("timing_summary", "issues_by_category", "plan_health", "compliance_metrics", "summary_counts")
QUALITY = {
    "null_ids_payroll": "payroll rows without an id, left out", "null_ids_rk": "recordkeeper rows without an id, left out",
    "bad_is_hce": "HCE flags that say neither yes nor no, taken as no",
}
AUDIT = "Run {run_id}, {rows} reconciled participants.\nResults of fixed rules over the files that manifest.json's hashes name; no opinion on compliance.\n"


@dataclass(frozen=True)
class Config:
    plan_name: str | None = None
    plan_year: int | None = None
    late_business_days: int = 5
    late_calendar_days: int = 5
    tolerance: float = 0.0
    termination_grace_days: int = 0
    eligibility_grace_days: int = 30
    eligibility: rules.EligibilityRule = rules.EligibilityRule()
    match: rules.MatchRule = rules.MatchRule()
    limits: dict[int, tuple[int, int]] = field(default_factory=lambda: dict(fixed.LIMITS))  # by year: base and catch-up
    secure20: bool = True
    payroll_vendor: str | None = None
    rk_vendor: str | None = None
    single_files: bool = False  # one CSV per table of rows, for small runs
    catalogue: str | None = None  # where runs are recorded
    workbook: tuple[str, ...] = ()  # tables that also become sheets of a workbook


@dataclass
class Result:
    run_id: str
    tables: dict[str, DataFrame]
    summary: dict = field(default_factory=dict)
    files: dict[str, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


class Engine:
    def __init__(self, spark: SparkSession, config: Config = Config()) -> None:
        self.spark, self.config = spark, config

    def canonical(self, payroll: DataFrame, rk: DataFrame, checks: bool = False) -> tuple[DataFrame, DataFrame, dict, list[str]]:
        """Both sides in canonical columns, by detected vendors or hints, the vendors, and notes on headers."""
        p, payroll_vendor, notes = files.prepared(payroll, "payroll", self.config.payroll_vendor, checks=checks)
        r, rk_vendor, more = files.prepared(rk, "rk", self.config.rk_vendor)
        return p, r, {"payroll": payroll_vendor, "rk": rk_vendor}, notes + more

    def tables(self, payroll: DataFrame, rk: DataFrame, warnings: list[str] | None = None, both: DataFrame | None = None) -> dict[str, DataFrame]:
        """All results of canonical sides, lazily. A rule whose columns are missing is left out. both may
        hold the joined sides, where they are kept."""
        c, warnings = self.config, [] if warnings is None else warnings
        both = reconcile.joined(payroll, rk) if both is None else both
        detail = timing.detail(payroll, rk, c.late_calendar_days)
        out = {
            "joined": both, "timing_detail": detail, "late_contributions": timing.exceptions(payroll, rk, c.late_calendar_days),
            "timing_summary": timing.summary(payroll, rk, c.late_calendar_days),
        }
        for s in reconcile.STREAMS:
            rows = reconcile.stream(both, s)
            name = s.removesuffix("s")
            out |= {
                f"recon_{s}": rows, f"{name}_mismatches": reconcile.mismatches(rows, c.tolerance), f"late_{s}_contributions": reconcile.late(rows, c.late_business_days),
                f"only_in_payroll_{s}": reconcile.only_in(rows, reconcile.LEFT), f"only_in_recordkeeper_{s}": reconcile.only_in(rows, reconcile.RIGHT),
            }
        have = set(payroll.columns)
        sources: dict[str, DataFrame] = {}

        def rule(name: str, needs: set[str], build) -> None:
            if needs <= have:
                sources[name] = build()
            else:
                warnings.append(f"{name}: skipped, columns missing: {sorted(needs - have)}")

        if c.secure20:
            dated = have & {"age", "dob"}
            rule("secure20", {"is_hce", "catchup_pretax", "catchup_roth", *([] if dated else ["dob"])}, lambda: rules.secure20(payroll))
        rule("eligibility", {"hire_date", "dob"}, lambda: rules.eligibility_drift(rules.eligibility_dates(payroll, payroll), c.eligibility, c.eligibility_grace_days))
        rule("comp_402g", {"catchup_pretax", "catchup_roth"}, lambda: rules.deferral_excess(rules.deferral_totals(payroll, c.plan_year, c.limits)))
        rule("match", {"compensation", "er_match"}, lambda: rules.match_check(payroll.withColumn("deferral", payroll["pretax"] + payroll["roth"]), c.match))
        if {"termination_date", "employment_status"} <= have:
            out["post_termination_contributions"] = rules.post_termination(payroll, c.termination_grace_days)
        out |= {f"{k}_issues": v for k, v in sources.items()}
        if sources:
            out["plan_exception_summary"] = issues.union_issues(sources, "", c.plan_name, c.plan_year)
            out["issues_by_category"] = issues.by_category(out["plan_exception_summary"])
            out["plan_health"] = issues.plan_health(out["plan_exception_summary"], payroll)
        return out | {"compliance_metrics": metrics.compliance_metrics(both), "summary_counts": metrics.summary_counts(both)}

    def run(
        self, payroll: DataFrame, rk: DataFrame, output: str | None = None, mapping: dict | None = None, inputs: dict[str, str] | None = None
    ) -> Result:
        """Raw sides to a result; with a mapping the preflight gate comes first, with an output folder
        tables, summary, manifest and ZIP are written, the ZIP last. The manifest holds hashes of the
        input files, where their paths are given by name."""
        if mapping is not None:
            report = preflight.run(payroll, rk, mapping)
            if not report.safe:
                raise RuntimeError("; ".join(report.errors))
        if output:
            sinks.refuse_inputs(output, [*(inputs or {}).values(), *payroll.inputFiles(), *rk.inputFiles()])
        run_id = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_") + uuid.uuid4().hex[:8]
        self._record(run_id, "running", inputs)
        try:
            result = self._run(run_id, payroll, rk, output, inputs or {})
        except Exception as e:
            self._record(run_id, "failed", inputs, error_message=str(e)[:2_000])
            raise
        told = {"summary_json": json.dumps(result.summary, default=str), "evidence_pack_path": result.files.get("evidence_pack")}
        if "manifest" in result.files and self.config.catalogue:
            told["manifest_json"] = storage.read(result.files["manifest"]).decode()
        self._record(run_id, "completed", inputs, **told)
        return result

    def _record(self, run_id: str, status: str, inputs: dict[str, str] | None, **more: object) -> None:
        """Notes the run in the catalogue, if there is one."""
        if self.config.catalogue:
            name = lambda k: storage.name_of((inputs or {}).get(k) or "") or None
            catalogue.record_run(
                self.config.catalogue, id=run_id, status=status, plan_name=self.config.plan_name, payroll_filename=name("payroll"),
                rk_filename=name("recordkeeper"), **more,
            )

    def _run(self, run_id: str, payroll: DataFrame, rk: DataFrame, output: str | None, inputs: dict[str, str]) -> Result:
        p, r, vendors, notes = self.canonical(payroll, rk, checks=True)
        held = [p.persist(), r.persist()]
        try:
            # The roll-ups and their join serve ten tables, three counts and two proofs.
            held.append(reconcile.joined(p, r).persist())
            result = Result(run_id, {}, warnings=notes)
            result.tables = self.tables(p.drop("bad_is_hce"), r, result.warnings, held[-1])
            # Counted in the pass that counts the timing.
            seen = {side: Observation(f"{side}_{run_id}") for side in ("payroll", "rk")}
            nulls = F.count_if(F.col("employee_id").isNull()).alias("null_ids")
            observed = p.observe(seen["payroll"], nulls, F.count_if("bad_is_hce").alias("bad_is_hce")), r.observe(seen["rk"], nulls)
            counted = timing.summary(*observed, self.config.late_calendar_days).first()
            t = result.tables
            t["timing_summary"] = self.spark.createDataFrame([counted], t["timing_summary"].schema)  # one row
            # The rules are evaluated once for their own tables, the union, its counts and the score.
            held += [rows.persist() for name, rows in t.items() if name.endswith("_issues")]
            one = lambda df: df.first().asDict()
            result.summary = {"run_id": run_id, "plan_name": self.config.plan_name, "payroll_vendor": vendors["payroll"], "rk_vendor": vendors["rk"]}
            result.summary |= one(metrics.run_totals(t["joined"])) | one(metrics.mismatch_counts(t["joined"], self.config.late_business_days))
            result.summary["timing"] = counted.asDict()
            quality = {f"null_ids_{side}": o.get["null_ids"] for side, o in seen.items()} | {"bad_is_hce": seen["payroll"].get["bad_is_hce"]}
            result.summary |= quality
            result.warnings += [f"{QUALITY[name]}: {n}" for name, n in quality.items() if n]
            result.summary["plan_year"] = self.config.plan_year or one(metrics.inferred_plan_year(p))["plan_year"]
            if "plan_health" in t:
                result.summary["plan_health"] = one(t["plan_health"])
            if output:
                self._write(result, output, inputs)
            return result
        finally:
            for rows in held:
                rows.unpersist()

    def _write(self, result: Result, output: str, inputs: dict[str, str]) -> None:
        storage.make_folder(output)
        sinks.clean(output)
        c, year = self.config, result.summary["plan_year"]
        for name, rows in result.tables.items():
            if name not in ("joined", "timing_detail"):
                rows = sinks.with_run(rows.drop("run_id", "plan_name", "plan_year") if name == "plan_exception_summary" else rows, result.run_id, c.plan_name, year)
                result.files[name] = sinks.write_csv(rows, storage.join(output, f"{name}.csv"), c.single_files or name in FEW_ROWS)
        if c.workbook:
            sheets = {n: result.tables[n] for n in c.workbook if n in result.tables}
            result.files["workbook"] = workbook.write_workbook(sheets, storage.join(output, "results.xlsx"))
        result.files["run_summary"] = sinks.write_json(result.summary, storage.join(output, "run_summary.json"))
        proofs = {n: integrity.proof_of(result.tables[n], "employee_id") for n in ("recon_deferrals", "recon_loans")}
        result.files["proofs"] = sinks.write_json(proofs, storage.join(output, "proofs.json"))
        roots = {n: p["merkle_root"] for n, p in proofs.items()}
        manifest = storage.join(output, f"manifest_{result.run_id}.json")
        integrity.write_manifest(manifest, inputs, result.files, {"plan_name": c.plan_name}, roots, list(result.files.values()))
        result.files["manifest"] = manifest
        notes = {"README.txt": f"Results of run {result.run_id}\n", "audit_summary.txt": AUDIT.format(run_id=result.run_id, rows=proofs["recon_deferrals"]["row_count"])}
        names = {"manifest": "manifest.json", "recon_deferrals": "results.csv", "plan_exception_summary": "violations.csv"}
        result.files["evidence_pack"] = sinks.seal(result.files, storage.join(output, "evidence_pack.zip"), notes, names)
        integrity.add_seal(manifest, result.files["evidence_pack"])


def evidence_index(result: Result) -> list[dict]:
    """key, name, category and path of every file written."""
    kind = lambda k: "Timing" if "late" in k or "timing" in k else "Reconciliation" if "mism" in k or "only_in" in k or "recon" in k else "Compliance"
    return [{"key": k, "name": k.replace("_", " ").title(), "category": kind(k), "path": p} for k, p in result.files.items() if storage.exists(p)]


def run_timing_analysis(spark: SparkSession, payroll_path: str, rk_path: str, output: str, late_days: int = 5) -> dict:
    """Deposit timing alone, from files to files: late and missing rows as CSV, the figures as JSON."""
    sinks.refuse_inputs(output, [payroll_path, rk_path])
    sides = [files.read_table(spark, path) for path in (payroll_path, rk_path)]
    p, r, *_ = Engine(spark).canonical(*sides)
    storage.make_folder(output)
    late = sinks.write_csv(timing.exceptions(p, r, late_days), storage.join(output, "late_contributions.csv"))
    counted = timing.summary(p, r, late_days).first().asDict()
    told = counted | {"generated_at": datetime.now(timezone.utc).isoformat(), "source_hash": None}
    summary = sinks.write_json(told, storage.join(output, "timing_summary.json"))
    figures = {k: counted[k] for k in ("total_rows", "late_rows", "missing_deposits")}
    return figures | {"timing_risk": counted["risk_level"], "late_contributions_path": late, "timing_summary_path": summary}


def run_evidence_pack(spark: SparkSession, payroll_path: str, rk_path: str, mapping_path: str, out_root: str, config: Config = Config()) -> dict:
    """A whole run in a folder of its own under out_root, gated by the mapping, with hashes of its three
    inputs and a sealed ZIP: run_id, output_dir, evidence_pack_zip_path and the manifest."""
    output = storage.join(out_root, f"run_{uuid.uuid4().hex}")
    inputs = {"payroll": payroll_path, "recordkeeper": rk_path, "mapping": mapping_path}
    sides = [files.read_table(spark, path) for path in (payroll_path, rk_path)]
    result = Engine(spark, config).run(*sides, output=output, mapping=files.read_mapping(mapping_path), inputs=inputs)
    manifest = json.loads(storage.read(result.files["manifest"]))
    return {"run_id": result.run_id, "output_dir": output, "evidence_pack_zip_path": result.files["evidence_pack"], "manifest": manifest}


def run_batches(spark: SparkSession, payroll: list[str], rk: list[str], plan_prefix: str = "Plan", late_days: int = 5) -> DataFrame:
    """The overview of many pairs of files, paired by position, in one job."""
    return metrics.batch_overview(*files.pair_batches(spark, payroll, rk, plan_prefix), late_days)


def safe_run(engine: Engine, payroll: DataFrame, rk: DataFrame, **how: object) -> dict:
    """run() as a summary that holds an error instead of raising one."""
    try:
        result = engine.run(payroll, rk, **how)
    except Exception as e:
        return {"error": str(e)}
    return result.summary | {"warnings": result.warnings, "files": result.files}


def main(args: list[str] | None = None) -> int:
    cli = argparse.ArgumentParser(description="Reconcile a payroll and a recordkeeper extract.")
    for name in ("payroll", "recordkeeper"):
        cli.add_argument(name)
    cli.add_argument("--output", default="output")
    for name in ("mapping", "plan-name", "payroll-vendor", "rk-vendor", "catalogue"):
        cli.add_argument(f"--{name}")
    cli.add_argument("--plan-year", type=int)
    cli.add_argument("--late-days", type=int, default=5)
    cli.add_argument("--single-files", action="store_true")
    cli.add_argument("--timing-only", action="store_true", help="late and missing deposits only")
    a = cli.parse_args(args)
    spark = SparkSession.builder.appName("ledgerlane").getOrCreate()
    if a.timing_only:
        print(json.dumps(run_timing_analysis(spark, a.payroll, a.recordkeeper, a.output, a.late_days), indent=2))
        return 0
    config = Config(
        plan_name=a.plan_name, plan_year=a.plan_year, late_business_days=a.late_days, late_calendar_days=a.late_days,
        payroll_vendor=a.payroll_vendor, rk_vendor=a.rk_vendor, single_files=a.single_files, catalogue=a.catalogue,
    )
    mapping = files.read_mapping(a.mapping) if a.mapping else None
    inputs = {k: p for k, p in (("payroll", a.payroll), ("recordkeeper", a.recordkeeper), ("mapping", a.mapping)) if p}
    sides = files.read_table(spark, a.payroll), files.read_table(spark, a.recordkeeper)
    out = safe_run(Engine(spark, config), *sides, output=a.output, mapping=mapping, inputs=inputs)
    print(json.dumps(out, indent=2, default=str))
    return int("error" in out)


if __name__ == "__main__":
    raise SystemExit(main())
