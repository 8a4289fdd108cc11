"""Payroll, recordkeeper and census tables derived from the star schema by arithmetic on keys.

Each view is a base table, a condition and select expressions that Spark and DuckDB both read, so one
text serves the query and its twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _money(factor: str, base: str = "l_extendedprice") -> str:
    return f"cast(cast({base} as decimal(18,2)) * cast({factor} as decimal(5,4)) as decimal(18,2))"


_ZERO = "cast(0 as decimal(18,2))"
_ID = "cast(l_orderkey as string) as employee_id"
_BATCH = "concat('batch-', cast(l_orderkey % 7 as string)) as batch_id"
_ROTH = f"case when l_returnflag = 'R' then {_money('0.02')} else {_ZERO} end as roth"

VIEWS = {
    "payroll": ("lineitem", "l_orderkey % 50 <> 7", [
        _ID, "cast(l_shipdate as date) as pay_date", f"{_money('0.05')} as pretax", _ROTH,
        f"case when l_linenumber = 1 and l_orderkey % 5 = 0 then cast(75.00 as decimal(18,2)) else {_ZERO} end as loan", _BATCH,
    ]),
    "rk": ("lineitem", "l_orderkey % 50 <> 11", [
        _ID, "cast(l_shipdate as date) + cast(case when l_orderkey % 20 = 3 then 9 else 1 + l_orderkey % 4 end as int) as deposit_date",
        f"case when l_orderkey % 10 = 4 and l_linenumber = 1 then {_money('0.06')} else {_money('0.05')} end as pretax", _ROTH,
        f"case when l_linenumber = 1 and l_orderkey % 10 = 0 then cast(75.00 as decimal(18,2)) else {_ZERO} end as loan", _BATCH,
    ]),
    "census": ("orders", "true", [
        "cast(o_orderkey as string) as employee_id", "date '1960-01-01' + cast(o_custkey * 37 % 16000 as int) as dob",
        "cast(o_orderdate as date) + cast(10227 - o_orderkey % 900 as int) as hire_date",
        "case when o_orderkey % 11 = 0 then cast(o_orderdate as date) + 10257 end as termination_date",
        "case when o_orderkey % 11 = 0 then 'Terminated' else 'Active' end as employment_status",
        "o_orderpriority in ('1-URGENT', '2-HIGH') as is_hce", "cast(o_totalprice as decimal(18,2)) as compensation",
    ]),
    "contrib": ("lineitem", "true", [
        _ID, "cast(l_shipdate as date) + 10227 as pay_date", f"{_money('0.20')} as pretax",
        f"case when l_returnflag = 'R' then {_money('0.05')} else {_ZERO} end as roth",
        f"case when l_linenumber = 2 and l_orderkey % 7 = 0 then cast(500 as decimal(18,2)) else {_ZERO} end as catchup_pretax",
        f"case when l_linenumber = 3 and l_orderkey % 7 = 1 then cast(500 as decimal(18,2)) else {_ZERO} end as catchup_roth",
    ]),
    "match": ("lineitem", "true", [
        _ID, "cast(l_shipdate as date) as pay_date", "cast(l_extendedprice as decimal(18,2)) as compensation",
        f"case when l_linenumber % 3 = 0 then {_money('0.08')} else {_money('0.05')} end as deferral",
        f"case when l_orderkey % 25 = 6 then {_money('0.010')} when l_orderkey % 25 = 9 then {_money('0.050')} "
        f"when l_linenumber % 3 = 0 then {_money('0.030')} else {_money('0.025')} end as er_match",
    ]),
    "money_types": ("lineitem", "true", [
        _ID, "cast(l_shipdate as date) as deposit_date",
        "case l_returnflag when 'R' then '457b_Roth' when 'A' then '457b_Pretax' else 'other' end as money_type", f"{_money('0.05')} as amount",
    ]),
    "raw_payroll": ("lineitem", "true", [
        "case when l_orderkey % 13 = 0 then '' else concat(' E', cast(l_orderkey as string), ' ') end as emp_no",
        "cast(cast(l_shipdate as date) as string) as paid", "concat('$', cast(cast(l_extendedprice as decimal(18,2)) as string)) as def_amount",
        "case when l_linenumber = 2 then 'n/a' else cast(cast(l_quantity as decimal(18,2)) as string) end as roth_amount",
        "case when l_linenumber = 3 then null else '12.50' end as loan_amount", "case l_returnflag when 'R' then 'Y' when 'A' then 'maybe' else '0' end as hce_flag",
    ]),
    "runs": ("orders", "true", [
        "concat('run-', cast(o_orderkey as string)) as id", "cast(o_orderdate as date) as created_at",
        "case when o_orderstatus = 'F' then 'completed' else 'failed' end as status", "concat('Plan ', cast(o_custkey % 40 as string)) as plan_name",
        "cast(o_orderkey % 30 as bigint) as deferral_mismatch_count", "cast(o_orderkey % 7 as bigint) as loan_mismatch_count",
        "cast(o_custkey % 3 as bigint) as late_deferral_count",
        "concat('payroll-', cast(o_custkey % 40 as string), '.csv') as payroll_filename",
        "concat('rk-', cast(o_custkey % 40 as string), '.csv') as rk_filename",
    ]),
    "run_records": ("orders", "true", [
        "concat('run-', cast(o_custkey as string)) as id", "cast(o_orderdate as timestamp) as created_at", "cast(o_orderdate as timestamp) as updated_at", "o_orderkey as recorded_at",
        "case when o_orderkey % 4 > 0 then o_orderstatus end as status", "concat('Plan ', cast(o_custkey % 40 as string)) as plan_name",
        "case when o_orderkey % 3 = 0 then concat('user-', cast(o_orderkey as string)) end as user_id", "'payroll.csv' as payroll_filename", "cast(null as string) as rk_filename",
        "case when o_orderkey % 2 = 0 then o_orderpriority end as summary_json", "case when o_orderkey % 5 = 0 then o_orderpriority end as manifest_json",
        "case when o_orderkey % 7 = 0 then concat('packs/', cast(o_orderkey as string), '.zip') end as evidence_pack_path", "case when o_orderkey % 11 = 0 then o_orderpriority end as error_message",
    ]),
    "batches": ("nation", "true", [
        "cast(n_nationkey + 1 as bigint) as run_no", "concat('batch-', cast(n_nationkey as string)) as batch_id", "concat('Plan #', cast(n_nationkey + 1 as string)) as plan_name",
        "concat('payroll-', cast(n_nationkey as string), '.csv') as payroll_file", "concat('rk-', cast(n_nationkey as string), '.csv') as rk_file",
        "case when n_nationkey % 3 = 0 then 'ADP' end as payroll_vendor", "case when n_nationkey % 2 = 0 then 'Fidelity' end as rk_vendor",
        "case when n_nationkey % 5 = 0 then concat('packs/', cast(n_nationkey as string), '.zip') end as evidence_pack",
    ]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, where, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{base}.parquet").filter(where).selectExpr(*columns)


def view_sql(*names: str) -> str:
    """The views as the opening of a WITH clause."""
    return "WITH " + ", ".join(f"v_{n} AS (SELECT {', '.join(VIEWS[n][2])} FROM {VIEWS[n][0]} WHERE {VIEWS[n][1]})" for n in names)
