"""Reading extracts: CSV as text columns, Excel, manifests of batches, mappings, the run catalogue."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.functions import fixed, headers
from ledgerlane.functions.scalar import MONEY, parse_amount, parse_date, parse_flag, unknown_flag
from ledgerlane.sources import records, storage, workbook

def read_csv(spark: SparkSession, path: str | list[str], with_path: bool = False) -> DataFrame:
    """All columns as text, headers trimmed; types come from explicit parsing, never inference. Files are
    read by as many tasks as they have splits, also where line feeds in quoted fields make records span
    lines (sources.records). with_path adds path_, each row's file."""
    if records.span_lines(spark, path):
        df = records.read_spanning(spark, path)
    else:
        df = spark.read.csv(path, header=True, inferSchema=False, **records.CSV)
        df = df.select("*", records.path_of_row().alias("path_"))
    *names, _ = [c.strip().removeprefix("\ufeff") for c in df.columns]
    out = df.toDF(*names, "path_")
    return out if with_path else out.drop("path_")


def read_headers(spark: SparkSession, path: str) -> list[str]:
    return [c.strip() for c in spark.read.csv(path, header=True).columns]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV, Parquet, or Excel (.xlsx), by suffix."""
    low = path.lower()
    if low.endswith(".xls"):
        raise ValueError(f"{path}: the old binary workbooks are not read, save it as .xlsx")
    if low.endswith(".xlsx"):
        return workbook.read_excel(spark, path)
    return spark.read.parquet(path) if low.endswith(".parquet") else read_csv(spark, path)


def read_if_there(spark: SparkSession, path: str, read: Callable = read_csv) -> DataFrame | None:
    return read(spark, path) if storage.exists(path) else None


def read_mapping(path: str) -> dict:
    """A mapping of sides to fields, YAML where PyYAML is there, or JSON."""
    text = storage.read(path).decode()
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text) or {}


def canonical(df: DataFrame, side: str, logical: dict[str, str] | None = None, keep: tuple[str, ...] = (), checks: bool = False) -> DataFrame:
    """A side in canonical columns and types from whatever headers it has, and the columns to keep as they
    are. Amounts not mapped are 0; a single amount column stands for the pre-tax amount when neither
    pre-tax nor Roth is there. With checks a payroll side has bad_is_hce: a flag that is neither yes nor no."""
    found = logical or headers.candidates(df.columns)
    prefix, date = ("payroll", "pay_date") if side == "payroll" else ("rk", "deposit_date")
    if "employee_id" not in found:
        raise ValueError(f"{side}: no employee id among {df.columns}")
    col = lambda name: F.col(f"`{found[name]}`")
    amount = lambda name: parse_amount(col(name)) if name in found else F.lit(0).cast(MONEY)
    alone = f"{prefix}_pretax" not in found and f"{prefix}_roth" not in found and "amount" in found
    out = {
        "employee_id": F.nullif(F.trim(col("employee_id").cast("string")), F.lit("")),
        date: parse_date(col(date)) if date in found else F.lit(None).cast("date"),
        "pretax": amount("amount") if alone else amount(f"{prefix}_pretax"), "roth": amount(f"{prefix}_roth"), "loan": amount(f"{prefix}_loan"),
    }
    if side == "payroll":
        out |= {
            "is_hce": parse_flag(col("is_hce")) if "is_hce" in found else F.lit(False),
            "catchup_pretax": amount("catchup_pretax"), "catchup_roth": amount("catchup_roth"),
        }
        for name, among in fixed.CENSUS_DATES.items():
            header = next((h for h in among if h in df.columns), None)
            if header:
                out[name] = parse_date(F.col(f"`{header}`"))
        for name in ("age", "employment_status"):
            if name in df.columns:
                out[name] = F.col(name).try_cast("int") if name == "age" else F.col(name)
        comp = next((c for c in ("Eligibility Compensation", "Plan Compensation", "Compensation", "compensation") if c in df.columns), None)
        if comp and "ER Match $" in df.columns:
            out |= {"compensation": parse_amount(F.col(f"`{comp}`")), "er_match": parse_amount(F.col("`ER Match $`"))}
        if checks:
            out["bad_is_hce"] = unknown_flag(col("is_hce")) if "is_hce" in found else F.lit(False)
    for header, name in headers.name_columns([c for c in df.columns if c not in keep]).items():
        out[name] = F.col(f"`{header}`")
    out |= {c: F.col(c) for c in keep}
    return df.select(*[c.alias(n) for n, c in out.items()])


def strict(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Target to source header; a header that isn't there is an error."""
    missing = [s for s in columns.values() if s not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.select(*[F.col(f"`{s}`").alias(t) for t, s in columns.items()])


def pivot_money_types(rows: DataFrame) -> DataFrame:
    """Recordkeeper rows by money type to one row per participant and date: pre-tax, Roth, loan 0."""
    out = rows.filter("employee_id is not null").groupBy("employee_id", "deposit_date").pivot("money_type", ["457b_Pretax", "457b_Roth"]).agg(F.sum("amount"))
    zero = F.lit(0).cast(MONEY)
    return out.select(
        "employee_id", "deposit_date", F.coalesce(F.col("`457b_Pretax`"), zero).alias("pretax"), F.coalesce(F.col("`457b_Roth`"), zero).alias("roth"),
        zero.alias("loan"),
    )


def prepared(
    df: DataFrame, side: str, hint: str | None = None, keep: tuple[str, ...] = (), checks: bool = False
) -> tuple[DataFrame, tuple[str, float], list[str]]:
    """A side (payroll or rk) in canonical columns by its vendor, which its headers tell or hint names;
    the vendor with its confidence; and headers that were left aside, since another has their name."""
    known, strict_maps = (fixed.PAYROLL_VENDORS, fixed.PAYROLL_STRICT) if side == "payroll" else (fixed.RK_VENDORS, fixed.RK_STRICT)
    of = lambda d: [c for c in d.columns if c not in keep]
    names = headers.amount_headers(of(df))
    aside = headers.left_aside(of(df), names)
    df = headers.renamed(df, names)
    vendor = headers.detect_vendor(of(df), known, hint)
    names = headers.vendor_headers(of(df), vendor[0], known)
    aside += headers.left_aside(of(df), names)
    df = headers.renamed(df, names)
    logical = headers.logical_columns(of(df), vendor[0], strict_maps)
    if f"{side}_loan" not in logical and "loan_amount" in df.columns:
        logical |= {f"{side}_loan": "loan_amount"}
    notes = [f"{side}: header {c!r} left aside, another one is {n!r}" for c, n in aside]
    return canonical(df, "payroll" if side == "payroll" else "recordkeeper", logical, keep, checks), vendor, notes


def first_lines(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """By path, as _metadata names it, the first line that isn't blank, of all files in one job."""
    rows = records.lines(spark, paths).withColumn("at", F.monotonically_increasing_id())
    first = rows.filter((F.col("start") == 0) & (F.trim("value") != "")).groupBy("path").agg(F.min(F.struct("at", "value")).alias("first"))
    return {r["path"]: r["value"].rstrip("\r") for r in first.select("path", "first.value").collect()}


def read_sides(spark: SparkSession, paths: list[str], side: str) -> tuple[DataFrame, dict[str, str]]:
    """All files of a side in canonical columns with path_, and each file's vendor. Files with the same
    headers are one scan, so plan and jobs grow with the kinds of headers, not with the files."""
    kinds: dict[str, list[str]] = {}
    for path, line in sorted(first_lines(spark, sorted(set(paths))).items()):
        kinds.setdefault(line, []).append(path)
    whole, vendors = None, {}
    for own in kinds.values():
        rows, (vendor, _), _ = prepared(read_csv(spark, own, with_path=True), side, keep=("path_",))
        vendors |= dict.fromkeys(own, vendor)
        whole = rows if whole is None else whole.unionByName(rows, allowMissingColumns=True)
    if whole is None:
        raise ValueError(f"{side}: no rows in {paths}")
    return whole, vendors


def _of_batches(spark: SparkSession, rows: DataFrame, of: list[tuple[str, str]]) -> DataFrame:
    """Rows with the batch_id of their file; (batch_id, path), a file may serve several batches."""
    names = spark.createDataFrame([(b, records.plain_path(storage.qualified(p))) for b, p in of], "batch_id string, path_ string")
    return rows.join(names, "path_").drop("path_")


def read_batches(spark: SparkSession, manifest: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of all batches of a manifest (batch_id, payroll_file, rk_file), each with batch_id."""
    batches = read_csv(spark, manifest).select("batch_id", "payroll_file", "rk_file").collect()  # a few names
    out = []
    for side, column in (("payroll", "payroll_file"), ("rk", "rk_file")):
        of = [(b["batch_id"], storage.join(folder, b[column])) for b in batches]
        out.append(_of_batches(spark, read_sides(spark, [p for _, p in of], side)[0], of))
    return out[0], out[1]


BATCHES = "run_no long, batch_id string, plan_name string, payroll_file string, rk_file string, payroll_vendor string, rk_vendor string, evidence_pack string"


def pair_batches(spark: SparkSession, payroll: list[str], rk: list[str], plan_prefix: str = "Plan") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files paired by position as batches, with the vendors that their headers tell, and both sides' rows
    with batch_id: what batch_overview() takes. Both lists must be as long."""
    if not payroll or len(payroll) != len(rk):
        raise ValueError(f"as many payroll as recordkeeper files are needed, one at least: {len(payroll)} and {len(rk)}")
    ids = [f"batch-{k}" for k in range(1, len(payroll) + 1)]
    sides, vendors = [], []
    for side, paths in (("payroll", payroll), ("rk", rk)):
        rows, own = read_sides(spark, paths, side)
        sides.append(_of_batches(spark, rows, list(zip(ids, paths, strict=True))))
        vendors.append([v if (v := own.get(records.plain_path(storage.qualified(p)))) != fixed.UNKNOWN_VENDOR else None for p in paths])
    names = [[storage.name_of(p) for p in paths] for paths in (payroll, rk)]
    listed = [(k + 1, ids[k], f"{plan_prefix} #{k + 1}", names[0][k], names[1][k], vendors[0][k], vendors[1][k], None) for k in range(len(ids))]
    return spark.createDataFrame(listed, BATCHES), sides[0], sides[1]


def split_blocks(text: str) -> dict[str, str]:
    """File name to CSV text, for a text of names followed each by a fenced block, or of one block
    with # name lines."""
    found = dict(re.findall(r"^#*\s*(\S+\.csv)\s*\n+```[a-z]*\n(.*?)\n```", text, flags=re.M | re.S))
    if found:
        return found
    parts = re.split(r"^#\s*(\S+\.csv)\s*$", text.replace("```", ""), flags=re.M)
    return {n: body.strip() for n, body in zip(parts[1::2], parts[2::2], strict=True)}


def get_run(catalogue: DataFrame, run_id: str) -> DataFrame:
    return catalogue.filter(F.col("id") == run_id)


