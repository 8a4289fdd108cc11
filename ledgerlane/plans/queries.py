"""All queries over the adapter views, each with its DuckDB twin where SQL can say it.

Decimals leave as doubles on both sides, so that results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.functions import fixed
from ledgerlane.functions.scalar import age_on, age_rounded, business_days, calendar_days, dollars, first_of_month, numeric, parse_amount, parse_date, parse_flag, years_after
from ledgerlane.operators import integrity, issues, metrics, preflight, reconcile, rules, timing
from ledgerlane.sources import catalogue, files, sinks
from ledgerlane.sources.adapter import view, view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
RUN_ID, PLAN, YEAR = "run-1", "Demo Plan", 2024


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles."""
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def add(name: str, build: Callable, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: plain(build(lambda v: view(spark, sf_dir, v)))
    if sql is not None:
        ORACLE[name] = sql


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case(column: str, values: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quoted(k)} THEN {v if isinstance(v, (int, float)) else quoted(v)}" for k, v in values.items()) + f" ELSE {default} END"


def meta(by: str) -> str:
    names = ("issue_category", "severity", "correction_hint")
    return ", ".join(f"{case(by, {k: v[i] for k, v in fixed.ISSUES.items()}, quoted(fixed.DEFAULT_ISSUE[i]))} AS {n}" for i, n in enumerate(names))


def busdays(a: str, b: str) -> str:
    before = lambda d: f"(((({d}) - DATE '1900-01-01') // 7) * 5 + least((({d}) - DATE '1900-01-01') % 7, 5))"
    return f"CAST(CASE WHEN {b} >= {a} THEN {before(b)} - {before(a)} WHEN {b} < {a} THEN -({before(a + ' + 1')} - {before(b + ' + 1')}) END AS INTEGER)"


# Reconciliation.
_JOINED = view_sql("payroll", "rk") + """, p AS (SELECT employee_id, sum(pretax + roth) AS deferral, sum(loan) AS loan, min(pay_date) AS pay_date FROM v_payroll
WHERE employee_id IS NOT NULL GROUP BY employee_id), r AS (SELECT employee_id, sum(pretax + roth) AS deferral, sum(loan) AS loan, min(deposit_date) AS deposit_date
FROM v_rk WHERE employee_id IS NOT NULL GROUP BY employee_id), j AS (SELECT coalesce(p.employee_id, r.employee_id) AS employee_id, p.deferral AS deferral_payroll,
p.loan AS loan_payroll, pay_date, r.deferral AS deferral_rk, r.loan AS loan_rk, deposit_date, CASE WHEN p.employee_id IS NOT NULL AND r.employee_id IS NOT NULL THEN 'both'
WHEN p.employee_id IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS merge_status FROM p FULL OUTER JOIN r ON p.employee_id = r.employee_id), f AS (SELECT *,
""" + busdays("pay_date", "deposit_date") + """ AS lag FROM j), g AS (SELECT *, coalesce(merge_status = 'both' AND lag > 5, false) AS late,
merge_status = 'both' AND deferral_payroll <> deferral_rk AS mis_d, merge_status = 'both' AND loan_payroll <> loan_rk AS mis_l FROM f) """


def _stream_sql(amount: str, where: str = "true") -> str:
    return _JOINED + f"""SELECT employee_id, CAST({amount}_payroll AS DOUBLE) AS amount_payroll, pay_date, CAST({amount}_rk AS DOUBLE) AS amount_rk, deposit_date, merge_status,
CASE WHEN merge_status = 'both' THEN CAST({amount}_payroll - {amount}_rk AS DOUBLE) END AS delta, lag AS business_days_lag FROM g WHERE {where}"""


def _joined(v: Callable) -> DataFrame:
    return reconcile.joined(v("payroll"), v("rk"))


for _side, _view, _date in (("payroll", "payroll", "pay_date"), ("rk", "rk", "deposit_date")):
    add(
        f"agg_{_side}_by_employee", lambda v, x=_view, d=_date: reconcile.roll_up(v(x), d),
        view_sql(_view) + f" SELECT employee_id, CAST(sum(pretax + roth) AS DOUBLE) AS deferral, CAST(sum(loan) AS DOUBLE) AS loan, min({_date}) AS {_date} FROM v_{_view} GROUP BY employee_id",
    )
for _name, _amount in reconcile.STREAMS.items():
    _short = "mis_d" if _amount == "deferral" else "mis_l"
    add(f"recon_{_name}", lambda v, s=_name: reconcile.stream(_joined(v), s), _stream_sql(_amount))
    add(f"{_amount}_mismatches", lambda v, s=_name: reconcile.mismatches(reconcile.stream(_joined(v), s)), _stream_sql(_amount, _short))
    add(f"late_{_name}_contributions", lambda v, s=_name: reconcile.late(reconcile.stream(_joined(v), s)), _stream_sql(_amount, "late"))
    for _label, _status in (("payroll", reconcile.LEFT), ("recordkeeper", reconcile.RIGHT)):
        add(f"only_in_{_label}_{_name}", lambda v, s=_name, t=_status: reconcile.only_in(reconcile.stream(_joined(v), s), t), _stream_sql(_amount, f"merge_status = '{_status}'"))
add("recon_deferrals_row_level", lambda v: reconcile.row_level(v("payroll"), v("rk")), view_sql("payroll", "rk") + """ SELECT coalesce(p.employee_id, r.employee_id) AS employee_id,
pay_date, CAST(p.pretax + p.roth AS DOUBLE) AS amount_payroll, deposit_date, CAST(r.pretax + r.roth AS DOUBLE) AS amount_rk, CASE WHEN p.employee_id IS NOT NULL AND
r.employee_id IS NOT NULL THEN 'both' WHEN p.employee_id IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS merge_status FROM v_payroll p FULL OUTER JOIN v_rk r ON p.employee_id = r.employee_id""")
add("business_day_lags", lambda v: v("rk").join(v("payroll").groupBy("employee_id").agg(F.min("pay_date").alias("pay_date")), "employee_id").select(
    "employee_id", "pay_date", "deposit_date", business_days(F.col("pay_date"), F.col("deposit_date")).alias("lag"), business_days(F.col("deposit_date"), F.col("pay_date")).alias("back")),
    view_sql("payroll", "rk") + ", p AS (SELECT employee_id, min(pay_date) AS pay_date FROM v_payroll GROUP BY employee_id) SELECT r.employee_id, pay_date, deposit_date, "
    + busdays("pay_date", "deposit_date") + " AS lag, " + busdays("deposit_date", "pay_date") + " AS back FROM v_rk r JOIN p ON r.employee_id = p.employee_id")

# Timing.
_DETAIL = view_sql("payroll", "rk") + """, d AS (SELECT trim(p.employee_id) AS employee_id, pay_date, p.pretax AS payroll_pretax, p.roth AS payroll_roth, p.loan AS payroll_loan,
p.pretax + p.roth + p.loan AS pay_total, deposit_date, r.pretax AS rk_pretax, r.roth AS rk_roth, r.loan AS rk_loan, r.pretax + r.roth + r.loan AS rk_total,
CASE WHEN deposit_date IS NOT NULL THEN CAST(greatest(deposit_date - pay_date, 0) AS INTEGER) END AS days_to_deposit FROM v_payroll p LEFT JOIN v_rk r ON p.employee_id = r.employee_id),
t AS (SELECT *, coalesce(days_to_deposit > 5, false) AS is_late, deposit_date IS NULL AS missing_deposit FROM d) """
_DETAIL_COLUMNS = "employee_id, pay_date, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("payroll_pretax", "payroll_roth", "payroll_loan", "pay_total", "rk_pretax", "rk_roth", "rk_loan", "rk_total")) \
    + ", deposit_date, days_to_deposit, is_late, missing_deposit"
_RISK = "CASE WHEN missing_deposits > 0 THEN 'High' WHEN late_rows > 0 THEN 'Medium' ELSE 'Low' END AS risk_level"
_SUMMARY = ", s AS (SELECT count(*) AS total_rows, count(*) FILTER (is_late) AS late_rows, count(*) FILTER (missing_deposit) AS missing_deposits FROM t) "


def _detail(v: Callable) -> DataFrame:
    return timing.detail(v("payroll"), v("rk"))


add("timing_detail", _detail, _DETAIL + f"SELECT {_DETAIL_COLUMNS} FROM t")
add("late_contributions", lambda v: timing.exceptions(v("payroll"), v("rk")), _DETAIL + f"SELECT {_DETAIL_COLUMNS} FROM t WHERE is_late OR missing_deposit")
add("timing_summary", lambda v: timing.summary(v("payroll"), v("rk")), _DETAIL.rstrip() + _SUMMARY + f"SELECT *, {_RISK} FROM s")
add("timing_counts", lambda v: timing.counts(v("payroll"), v("rk")), _DETAIL.rstrip() + """ SELECT count(*) AS total_rows, count(*) FILTER (is_late) AS late_rows, count(*) FILTER (missing_deposit) AS missing_deposits,
count(days_to_deposit) AS pairs, CAST(coalesce(sum(days_to_deposit), 0) AS BIGINT) AS total_days, max(days_to_deposit) AS max_days FROM t""")
add("timing_risk", lambda v: timing.risk_with_drivers(v("payroll"), v("rk")), _DETAIL.rstrip() + """, s AS (SELECT count(*) AS total_rows, count(*) FILTER (is_late) AS late_rows,
count(*) FILTER (missing_deposit) AS missing_deposits, max(days_to_deposit) AS max_days, round(avg(days_to_deposit), 6) AS avg_days FROM t), q AS (SELECT *,
(late_rows + missing_deposits) / greatest(total_rows, 1) AS rate FROM s) SELECT total_rows, late_rows, missing_deposits, max_days, avg_days, round(rate, 6) AS exception_rate,
CASE WHEN rate <= 0.05 THEN 'Low' WHEN rate <= 0.15 THEN 'Medium' ELSE 'High' END AS rate_risk, CASE WHEN max_days > 15 THEN 'High' WHEN max_days > 8 THEN 'Medium' ELSE 'Low' END AS lag_risk FROM q""")

# Rules.
_AGE = "CAST(floor(({d} - dob) / 365.25) AS INTEGER)"


def _people(v: Callable) -> DataFrame:
    return v("contrib").join(v("census"), "employee_id")


_PEOPLE = view_sql("contrib", "census") + ", e AS (SELECT c.*, s.dob, s.hire_date, s.termination_date, s.employment_status, s.is_hce, " + _AGE.format(d="pay_date") \
    + " AS age, catchup_pretax + catchup_roth AS catchup_amount FROM v_contrib c JOIN v_census s ON c.employee_id = s.employee_id)"
_S20 = _PEOPLE + f""", x AS (SELECT *, CASE WHEN is_hce AND age >= 50 AND catchup_pretax > 0 AND catchup_roth = 0 THEN {quoted(rules.HCE_ROTH)}
WHEN age >= 50 AND catchup_amount = 0 THEN {quoted(rules.MISCODED)} END AS violation_type FROM e), s20 AS (SELECT employee_id, age, is_hce, CAST(pretax AS DOUBLE) AS deferral_pretax,
CAST(roth AS DOUBLE) AS deferral_roth, CAST(catchup_amount AS DOUBLE) AS catchup_amount, violation_type, {case("violation_type", {k: fixed.FIXES[k] for k in (rules.HCE_ROTH, rules.MISCODED)}, "NULL")}
AS recommended_fix, {meta("violation_type")} FROM x WHERE violation_type IS NOT NULL) """


def _s20(v: Callable) -> DataFrame:
    return rules.secure20(_people(v))


add("secure20_violations", _s20, _S20 + "SELECT * FROM s20")
add("secure20_ages_from_dob", lambda v: rules.secure20(_aged(v).withColumn("age", F.when(F.col("employee_id").cast("bigint") % 3 != 0, F.col("age") + 1))),
    _S20.replace(_AGE.format(d="pay_date") + " AS age", "CASE WHEN CAST(c.employee_id AS BIGINT) % 3 <> 0 THEN 1 ELSE 0 END + " + _AGE.format(d="pay_date") + " AS age") + "SELECT * FROM s20")
add("secure20_summary", lambda v: rules.secure20_summary(_s20(v)), _S20 + f"""SELECT count(*) AS total_violations, count(*) FILTER (violation_type = {quoted(rules.HCE_ROTH)}) AS hce_violation_count,
count(*) FILTER (violation_type = {quoted(rules.MISCODED)}) AS potential_catchup_miscode_count FROM s20""")
add("secure20_by_type", lambda v: _s20(v).groupBy("violation_type").agg(F.count(F.lit(1)).alias("violations")), _S20 + "SELECT violation_type, count(*) AS violations FROM s20 GROUP BY violation_type")
add("secure20_exceptions", lambda v: rules.secure20_demo(_people(v).withColumn("age", F.floor(F.datediff("pay_date", "dob") / 365.25).cast("int"))),
    _PEOPLE + f" SELECT employee_id, age, is_hce, CAST(pretax AS DOUBLE) AS pretax_amount, CAST(roth AS DOUBLE) AS roth_amount, {quoted(fixed.CATCHUP_DEMO_REASON)} AS reason FROM e WHERE is_hce AND age >= 50 AND pretax > 0 AND roth = 0")
add("post_termination_contributions", lambda v: rules.post_termination(_people(v)), _PEOPLE + """ SELECT employee_id, employment_status, termination_date, pay_date,
CAST(pay_date - termination_date AS INTEGER) AS days_after_termination, CAST(pretax AS DOUBLE) AS def_amount, CAST(roth AS DOUBLE) AS roth_amount, CAST(pretax + roth AS DOUBLE) AS total_contribution
FROM e WHERE termination_date IS NOT NULL AND pay_date > termination_date AND pretax + roth > 0""")

_TOTALS = _PEOPLE + """, y AS (SELECT employee_id, CAST(year(pay_date) AS INTEGER) AS plan_year, sum(pretax + roth) AS b, sum(catchup_pretax + catchup_roth) AS c, max(age) AS age FROM e
GROUP BY employee_id, year(pay_date)), z AS (SELECT *, coalesce(age >= 50, false) OR c > 0 AS el, """ + "CASE plan_year " + " ".join(f"WHEN {y} THEN {b}" for y, (b, _) in fixed.LIMITS.items()) \
    + f" ELSE {fixed.LIMITS[max(fixed.LIMITS)][0]} END AS base, CASE plan_year " + " ".join(f"WHEN {y} THEN {c}" for y, (_, c) in fixed.LIMITS.items()) + f" ELSE {fixed.LIMITS[max(fixed.LIMITS)][1]} END AS cu FROM y), " \
    + """tot AS (SELECT employee_id, plan_year, CAST(b AS DOUBLE) AS total_base_deferrals, CAST(c AS DOUBLE) AS total_catchup_deferrals, age, CAST(b + c AS DOUBLE) AS total_deferrals,
el AS is_catchup_eligible, CAST(base AS DOUBLE) AS base_limit, CAST(cu AS DOUBLE) AS catchup_limit, CAST(base + CASE WHEN el THEN cu ELSE 0 END AS DOUBLE) AS allowed_limit,
CAST(greatest(b + c - base - CASE WHEN el THEN cu ELSE 0 END, 0) AS DOUBLE) AS excess_amount FROM z) """


def _aged(v: Callable) -> DataFrame:
    return _people(v).withColumn("age", F.floor(F.datediff("pay_date", "dob") / 365.25).cast("int"))


_EXCESS = f", exc AS (SELECT * EXCLUDE (age), '402(g) excess deferrals' AS issue_type, {meta(quoted('402(g) excess deferrals'))} FROM tot WHERE excess_amount > 0) "
add("comp_402g_totals", lambda v: rules.deferral_totals(_aged(v)), _TOTALS + "SELECT * FROM tot")
add("comp_402g_violations", lambda v: rules.deferral_excess(rules.deferral_totals(_aged(v))), _TOTALS.rstrip() + _EXCESS + "SELECT * FROM exc")

_DATES = view_sql("contrib", "census") + """, k AS (SELECT employee_id, min(hire_date) AS hire_date, min(dob) AS dob FROM v_census GROUP BY employee_id), fd AS (SELECT employee_id,
min(CASE WHEN pretax + roth > 0 THEN pay_date END) AS first_deferral_date FROM v_contrib WHERE CAST(employee_id AS BIGINT) % 9 <> 4 GROUP BY employee_id), ed AS (SELECT k.*, first_deferral_date
FROM k LEFT JOIN fd ON k.employee_id = fd.employee_id)"""


def _dates(v: Callable) -> DataFrame:
    return rules.eligibility_dates(v("census"), v("contrib").filter("cast(employee_id as bigint) % 9 <> 4"))


def _drift_sql(due: str) -> str:
    return _DATES + f""", due AS (SELECT *, CAST({due} AS DATE) AS u FROM ed), iss AS (SELECT *, CASE WHEN u IS NULL THEN NULL WHEN first_deferral_date IS NULL THEN {quoted(rules.NO_START)}
WHEN first_deferral_date > u + 30 THEN {quoted(rules.LATE_START)} END AS issue_type FROM due), drift AS (SELECT employee_id, hire_date, dob, CAST(trunc(round_even((u - dob) / 365.25, 1)) AS INTEGER) AS age_at_eligibility,
u AS computed_eligibility_date, first_deferral_date, CAST(first_deferral_date - u AS INTEGER) AS drift_days, issue_type,
{case("issue_type", {k: fixed.FIXES[k] for k in (rules.NO_START, rules.LATE_START)}, "NULL")} AS recommended_fix, {meta("issue_type")} FROM iss WHERE issue_type IS NOT NULL) """


_DUE = {
    "immediate": (rules.EligibilityRule("immediate"), "hire_date"),
    "age21_1y": (rules.EligibilityRule(), "greatest(hire_date + 365, CAST(dob + INTERVAL 21 YEAR AS DATE))"),
    "service_only": (rules.EligibilityRule("service_only", service_days=90), "hire_date + 90"),
    "age_only": (rules.EligibilityRule("age_only"), "CAST(dob + INTERVAL 21 YEAR AS DATE)"),
    "aligned": (
        rules.EligibilityRule(align_first_month=True),
        "CASE WHEN day(greatest(hire_date + 365, CAST(dob + INTERVAL 21 YEAR AS DATE))) = 1 THEN greatest(hire_date + 365, CAST(dob + INTERVAL 21 YEAR AS DATE)) "
        "ELSE CAST(date_trunc('month', greatest(hire_date + 365, CAST(dob + INTERVAL 21 YEAR AS DATE))) + INTERVAL 1 MONTH AS DATE) END",
    ),
}
add("eligibility_dates", _dates, _DATES + " SELECT * FROM ed")
for _kind, (_rule, _due) in _DUE.items():
    add(f"eligibility_drift_{_kind}", lambda v, r=_rule: rules.eligibility_drift(_dates(v), r), _drift_sql(_due) + "SELECT * FROM drift")

_MATCH = view_sql("match") + f""", m AS (SELECT *, CAST(compensation AS DOUBLE) AS comp, CAST(deferral AS DOUBLE) AS d, CAST(er_match AS DOUBLE) AS a FROM v_match WHERE compensation > 0), n AS (SELECT *,
d / comp AS pct, comp * least(d / comp, 0.06::DOUBLE) * 0.5::DOUBLE AS expected FROM m), o AS (SELECT *, a - expected AS gap, (a - expected) / CASE WHEN expected = 0 THEN 1 ELSE expected END AS rel FROM n),
w AS (SELECT *, abs(gap) <= 5 AND abs(rel) <= 0.15 AS within FROM o), mt AS (SELECT *, CASE WHEN NOT within AND gap < 0 THEN 'Under-match' WHEN NOT within AND gap > 0 THEN 'Over-match' END AS issue_type FROM w),
mi AS (SELECT employee_id, pay_date, comp AS eligible_comp, d AS ee_deferral_amount, pct AS deferral_pct, a AS er_match_amount, expected AS expected_match, gap AS variance, rel AS variance_pct, issue_type,
{meta("issue_type")} FROM mt WHERE issue_type IS NOT NULL) """
_ROUNDED = ("deferral_pct", "expected_match", "variance", "variance_pct")


def _match(v: Callable) -> DataFrame:
    return rules.match_check(v("match"))


add("match_issues", lambda v: _match(v).withColumns({c: F.round(c, 6) for c in _ROUNDED}),
    _MATCH + "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in _ROUNDED) + ") FROM mi")
add("match_summary", lambda v: rules.match_summary(_match(v)), _MATCH + """SELECT count(*) AS total_issues, count(*) FILTER (issue_type = 'Under-match') AS under_match_count,
count(*) FILTER (issue_type = 'Over-match') AS over_match_count FROM mi""")
add("issue_taxonomy_join", lambda v: issues.with_metadata(v("runs").select("id", F.element_at(F.array(*[F.lit(x) for x in (*fixed.ISSUES, "Something else")]), (F.col("deferral_mismatch_count") % 8 + 1).cast("int")).alias("issue_type"))),
    view_sql("runs") + ", i AS (SELECT id, CASE deferral_mismatch_count % 8 " + " ".join(f"WHEN {k} THEN {quoted(x)}" for k, x in enumerate((*fixed.ISSUES, "Something else"))) + f" END AS issue_type FROM v_runs) SELECT *, {meta('issue_type')} FROM i")

# Union of issues and plan health.


def _sources(v: Callable) -> dict[str, DataFrame]:
    return {
        "secure20": _s20(v), "eligibility": rules.eligibility_drift(_dates(v), rules.EligibilityRule()),
        "comp_402g": rules.deferral_excess(rules.deferral_totals(_aged(v))), "match": _match(v),
    }


def _issues(v: Callable) -> DataFrame:
    return issues.union_issues(_sources(v), RUN_ID, PLAN, YEAR)


def _cte(sql: str) -> str:
    """The parts of a WITH clause."""
    return sql.strip().removeprefix("WITH ")


def _cents(c: str) -> str:
    return f"CAST(CAST(CAST(round({c}, 6) AS DECIMAL(24,6)) AS DECIMAL(24,2)) AS VARCHAR)"


def _money(c: str) -> str:
    return f"'{c}=$' || {_cents(c)}"


def _union_sql() -> str:
    drift = _drift_sql(_DUE["age21_1y"][1])
    shared = view_sql("contrib", "census", "match")
    own = lambda sql, *views: _cte(sql).removeprefix(_cte(view_sql(*views))).lstrip(", ")
    totals = own(_TOTALS.rstrip() + _EXCESS, "contrib", "census")
    s20 = own(_S20, "contrib", "census").removeprefix(own(_PEOPLE, "contrib", "census")).lstrip(", ")
    parts = [shared, totals, s20, own(drift, "contrib", "census"), own(_MATCH, "match")]
    row = lambda source, table, details, issue="issue_type": (
        f"SELECT '{RUN_ID}' AS run_id, '{PLAN}' AS plan_name, {YEAR} AS plan_year, employee_id, issue_category, {issue} AS issue_type, severity, '{source}' AS source, "
        f"{details} || '.' AS details, correction_hint FROM {table}"
    )
    unions = [
        row("secure20", "s20", f"concat_ws(', ', 'Secure 2.0 issue_type=' || violation_type, CASE WHEN deferral_pretax + deferral_roth > 0 THEN 'total_deferral=$' || {_cents('deferral_pretax + deferral_roth')} END, "
            f"CASE WHEN catchup_amount > 0 THEN 'catchup_amount=$' || {_cents('catchup_amount')} END)", "violation_type"),
        row("eligibility", "drift", "concat_ws(', ', 'Eligibility issue_type=' || issue_type, 'eligibility=' || CAST(computed_eligibility_date AS VARCHAR), 'first_deferral=' || CAST(first_deferral_date AS VARCHAR), "
            "'drift_days=' || CAST(drift_days AS VARCHAR))"),
        row("comp_402g", "exc", f"concat_ws(', ', '402(g) issue_type=' || issue_type, {_money('total_deferrals')}, {_money('allowed_limit')}, {_money('excess_amount')})"),
        row("match", "mi", f"concat_ws(', ', 'Match issue_type=' || issue_type, {', '.join(map(_money, ('eligible_comp', 'expected_match', 'er_match_amount', 'variance')))})"),
    ]
    return ", ".join([parts[0], *parts[1:]]) + ", allissues AS (" + " UNION ALL ".join(unions) + ") "


_UNION = _union_sql()
add("plan_exception_summary", _issues, _UNION + "SELECT * FROM allissues")
add("issues_by_category", lambda v: issues.by_category(_issues(v)), _UNION + "SELECT issue_category, count(*) AS issues FROM allissues GROUP BY issue_category")
add("issues_with_run_metadata", lambda v: sinks.with_run(_s20(v).select("employee_id", "violation_type", "severity"), RUN_ID, PLAN, YEAR),
    _S20 + f"SELECT employee_id, violation_type, severity, '{RUN_ID}' AS run_id, '{PLAN}' AS plan_name, {YEAR} AS plan_year FROM s20")
_GRADES = """CASE WHEN x >= 90 THEN 'A' WHEN x >= 80 THEN 'B' WHEN x >= 70 THEN 'C' WHEN x >= 60 THEN 'D' ELSE 'F' END AS grade, CASE WHEN x >= 85 THEN 'Low' WHEN x >= 70 THEN 'Moderate' ELSE 'High' END AS risk_level"""


def _health_sql(where: str) -> str:
    return _UNION + f""", wt AS (SELECT CAST(coalesce(sum({case("issue_category", fixed.WEIGHTS, str(fixed.WEIGHTS["Other"]))}), 0) AS BIGINT) AS weighted_violations FROM allissues WHERE {where}), pp AS (SELECT greatest(count(DISTINCT employee_id), 1)
AS total_participants FROM v_contrib), sc AS (SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE - weighted_violations / total_participants * 100.0::DOUBLE)) AS x FROM wt, pp)
SELECT weighted_violations, total_participants, round_even(x, 1) AS score, {_GRADES} FROM sc"""


add("plan_health", lambda v: issues.plan_health(_issues(v), v("contrib")), _health_sql("true"))
add("plan_health_match", lambda v: issues.plan_health(_issues(v).filter("source = 'match' and severity = 'Medium'"), v("contrib")), _health_sql("source = 'match' AND severity = 'Medium'"))

# Metrics.
_SUMS = ", ".join(f"CAST(sum({a}_{side}) AS DOUBLE) AS total_{s}_{side}" for s, a in reconcile.STREAMS.items() for side in ("payroll", "rk"))
_COUNTS = """count(*) FILTER (mis_d) AS deferral_mismatch_count, count(*) FILTER (mis_l) AS loan_mismatch_count, count(*) FILTER (merge_status = 'left_only') AS only_payroll_count,
count(*) FILTER (merge_status = 'right_only') AS only_rk_count, count(*) FILTER (late) AS late_deferral_count, count(*) FILTER (late) AS late_loan_count"""
add("run_totals", lambda v: metrics.run_totals(_joined(v)), _JOINED + f"SELECT {_SUMS} FROM g")
add("mismatch_counts", lambda v: metrics.mismatch_counts(_joined(v)), _JOINED + f"SELECT {_COUNTS} FROM g")
add("summary_counts", lambda v: metrics.summary_counts(_joined(v)), _JOINED.rstrip() + f", c AS (SELECT {_COUNTS} FROM g) " + " UNION ALL ".join(
    f"SELECT '{s}' AS stream, '{k}' AS category, {c} AS rows FROM c" for s, a in reconcile.STREAMS.items()
    for k, c in (("only_in_payroll", "only_payroll_count"), ("only_in_recordkeeper", "only_rk_count"), ("mismatches", f"{a}_mismatch_count"), ("late", f"late_{a}_count"))))


def _metrics_sql() -> str:
    late, left, right = "count(*) FILTER (late)", "count(*) FILTER (merge_status = 'left_only')", "count(*) FILTER (merge_status = 'right_only')"
    values = [
        late, late, "count(DISTINCT employee_id) FILTER (late)", "max(lag) FILTER (late)", "round_even(avg(lag) FILTER (late), 2)", "count(*) FILTER (mis_d)",
        "count(*) FILTER (mis_l)", "count(DISTINCT employee_id) FILTER (mis_d OR mis_l)", left, right, left, right,
    ]
    return _JOINED + " UNION ALL ".join(
        f"SELECT {quoted(x)} AS category, {quoted(y)} AS metric, {quoted(z)} AS notes, CAST({e} AS DOUBLE) AS value FROM g" for (x, y, z), e in zip(fixed.METRICS, values, strict=True))


add("compliance_metrics", lambda v: metrics.compliance_metrics(_joined(v)), _metrics_sql())
add("inferred_plan_year", lambda v: metrics.inferred_plan_year(v("contrib")), view_sql("contrib") + " SELECT CAST(max(year(pay_date)) AS INTEGER) AS plan_year FROM v_contrib")
_RUN = _JOINED.rstrip() + ", " + _cte(_DETAIL).removeprefix(_cte(view_sql("payroll", "rk"))).lstrip(", ").rstrip() + _SUMMARY.rstrip() + f", c AS (SELECT {_COUNTS} FROM g) "
_RUN_RISK = "CASE WHEN missing_deposits > 0 THEN 'High' WHEN late_rows > 0 OR late_deferral_count > 0 OR deferral_mismatch_count > 0 OR loan_mismatch_count > 0 THEN 'Medium' ELSE 'Low' END"
_BATCH_RISK = "CASE WHEN {d} > 100 OR {l} > 50 OR {t} > 50 THEN 'High' WHEN {d} > 10 OR {l} > 5 OR {t} > 10 THEN 'Medium' ELSE 'Low' END"
add("run_risk_levels", lambda v: metrics.risk_levels(_joined(v), timing.summary(v("payroll"), v("rk"))), _RUN + f"""SELECT {_RUN_RISK} AS run_risk, CASE WHEN late_deferral_count > 0 THEN 'High'
WHEN deferral_mismatch_count + loan_mismatch_count > 0 THEN 'Medium' ELSE 'Low' END AS narrative_risk, {_BATCH_RISK.format(d="deferral_mismatch_count", l="loan_mismatch_count", t="late_deferral_count")} AS batch_risk FROM c, s""")
add("anomaly_narrative", lambda v: metrics.narrative(_joined(v), timing.summary(v("payroll"), v("rk")), metrics.sample_ids(reconcile.mismatches(reconcile.stream(_joined(v), "deferrals")))),
    _RUN + f"""SELECT concat_ws('; ', deferral_mismatch_count || ' deferral and ' || loan_mismatch_count || ' loan amounts differ between payroll and recordkeeper', CASE WHEN late_deferral_count > 0 THEN
late_deferral_count || ' participants were paid in late' ELSE 'no deposit was late' END, (SELECT 'differing deferrals include participants ' ||
string_agg(employee_id, ', ' ORDER BY employee_id) FROM (SELECT DISTINCT employee_id FROM g WHERE mis_d ORDER BY employee_id LIMIT 3)), 'risk of this run: ' || {_RUN_RISK}) || '.' AS narrative FROM c, s""")
add("sample_mismatch_ids", lambda v: metrics.sample_ids(reconcile.mismatches(reconcile.stream(_joined(v), "deferrals"))), _JOINED + "SELECT DISTINCT employee_id FROM g WHERE mis_d ORDER BY employee_id LIMIT 3")
_BATCHES = view_sql("payroll", "rk") + """, p AS (SELECT batch_id, employee_id, sum(pretax + roth) AS deferral, sum(loan) AS loan, min(pay_date) AS pay_date FROM v_payroll GROUP BY batch_id, employee_id),
r AS (SELECT batch_id, employee_id, sum(pretax + roth) AS deferral, sum(loan) AS loan, min(deposit_date) AS deposit_date FROM v_rk GROUP BY batch_id, employee_id), q AS (SELECT coalesce(p.batch_id, r.batch_id) AS batch_id,
p.deferral AS dp, r.deferral AS dr, p.loan AS lp, r.loan AS lr, p.employee_id IS NOT NULL AND r.employee_id IS NOT NULL AS b, """ + busdays("pay_date", "deposit_date") + """ AS lag FROM p FULL OUTER JOIN r
ON p.batch_id = r.batch_id AND p.employee_id = r.employee_id), a AS (SELECT batch_id, CAST(sum(dp) AS DOUBLE) AS deferrals_payroll, CAST(sum(dr) AS DOUBLE) AS deferrals_rk, count(*) FILTER (b AND dp <> dr) AS deferral_mismatches,
count(*) FILTER (b AND lp <> lr) AS loan_mismatches, count(*) FILTER (b AND lag > 5) AS late_deferrals FROM q GROUP BY batch_id) SELECT *, """ + _BATCH_RISK.format(d="deferral_mismatches", l="loan_mismatches", t="late_deferrals") + " AS risk FROM a"
add("batch_dashboard", lambda v: metrics.batch_dashboard(v("payroll"), v("rk")), _BATCHES)
add("batch_risk", lambda v: metrics.batch_dashboard(v("payroll"), v("rk")).select("batch_id", "risk"), _BATCHES.replace("SELECT *, CASE WHEN deferral_mismatches > 100", "SELECT batch_id, CASE WHEN deferral_mismatches > 100"))
_FIGURES = ("deferrals_payroll", "deferrals_rk", "deferral_mismatches", "loan_mismatches", "late_deferrals")
add("batch_overview", lambda v: metrics.batch_overview(v("batches"), v("payroll"), v("rk")), view_sql("batches") + ", " + _BATCHES.removeprefix("WITH ").rsplit(" SELECT *, CASE", 1)[0] + f""", o AS (
SELECT b.* EXCLUDE (payroll_vendor, rk_vendor, evidence_pack), coalesce(payroll_vendor, 'Unknown') AS payroll_vendor, coalesce(rk_vendor, 'Unknown') AS rk_vendor, coalesce(evidence_pack, 'N/A') AS evidence_pack,
{", ".join(f"coalesce(a.{c}, 0) AS {c}" for c in _FIGURES)} FROM v_batches b LEFT JOIN a ON a.batch_id = b.batch_id)
SELECT *, {_BATCH_RISK.format(d="deferral_mismatches", l="loan_mismatches", t="late_deferrals")} AS risk FROM o""")

# The run catalogue.
_RUNS = view_sql("runs")
add("recent_runs", lambda v: metrics.recent_runs(v("runs")), _RUNS + " SELECT * FROM v_runs ORDER BY created_at DESC, id DESC LIMIT 50")
add("runs_lookup", lambda v: files.get_run(v("runs"), "run-100"), _RUNS + " SELECT * FROM v_runs WHERE id = 'run-100'")
_NEWEST = ("updated_at", "status", "plan_name", "user_id", "payroll_filename", "rk_filename", "summary_json", "manifest_json", "evidence_pack_path", "error_message")
add("catalogue_runs", lambda v: catalogue.merged(v("run_records")), view_sql("run_records") + " SELECT id, min(created_at) AS created_at, "
    + ", ".join(f"arg_max({c}, (updated_at, recorded_at)) FILTER ({c} IS NOT NULL) AS {c}" for c in _NEWEST) + " FROM v_run_records GROUP BY id")
add("run_history", lambda v: metrics.run_history(v("runs")), _RUNS + """, h AS (SELECT *, deferral_mismatch_count + loan_mismatch_count + late_deferral_count AS total_issues FROM v_runs) SELECT *,
CASE WHEN total_issues = 0 THEN 'Low' WHEN total_issues <= 20 THEN 'Medium' ELSE 'High' END AS risk FROM h""")

# Cleaning and preflight over text columns.
_AMOUNT = "coalesce(CAST(TRY_CAST(regexp_replace(trim({c}), '[$,]', '', 'g') AS DECIMAL(18,2)) AS DOUBLE), 0)"
_FLAG = "coalesce(lower(trim(hce_flag)) IN ('true', '1', 'yes', 'y') OR TRY_CAST(trim(hce_flag) AS DOUBLE) <> 0, false)"
_RAW = view_sql("raw_payroll")
_MAPPED = {"employee_id": "emp_no", "pay_date": "paid", "payroll_pretax": "def_amount", "payroll_roth": "roth_amount", "payroll_loan": "loan_amount", "is_hce": "hce_flag"}
add("normalize_payroll_generic", lambda v: files.canonical(v("raw_payroll"), "payroll", _MAPPED), _RAW + f""" SELECT nullif(trim(emp_no), '') AS employee_id, CAST(paid AS DATE) AS pay_date,
{_AMOUNT.format(c="def_amount")} AS pretax, {_AMOUNT.format(c="roth_amount")} AS roth, {_AMOUNT.format(c="loan_amount")} AS loan, {_FLAG} AS is_hce, 0.0::DOUBLE AS catchup_pretax, 0.0::DOUBLE AS catchup_roth FROM v_raw_payroll""")
add("normalize_rk_generic", lambda v: files.canonical(v("raw_payroll"), "recordkeeper", {"employee_id": "emp_no", "deposit_date": "paid", "amount": "def_amount"}), _RAW + f""" SELECT nullif(trim(emp_no), '') AS employee_id,
CAST(paid AS DATE) AS deposit_date, {_AMOUNT.format(c="def_amount")} AS pretax, 0.0::DOUBLE AS roth, 0.0::DOUBLE AS loan FROM v_raw_payroll""")
add("derived_deferral", lambda v: v("raw_payroll").select("emp_no", parse_date(F.col("paid")).alias("paid"), (parse_amount(F.col("def_amount")) + parse_amount(F.col("roth_amount"))).alias("deferral_amount")),
    _RAW + f" SELECT emp_no, CAST(paid AS DATE) AS paid, round({_AMOUNT.format(c='def_amount')} + {_AMOUNT.format(c='roth_amount')}, 2) AS deferral_amount FROM v_raw_payroll")
add("derived_loan", lambda v: v("raw_payroll").select("emp_no", parse_amount(F.col("loan_amount")).alias("payroll_loan"), F.lit(0.0).alias("rk_loan")),
    _RAW + f" SELECT emp_no, {_AMOUNT.format(c='loan_amount')} AS payroll_loan, 0.0::DOUBLE AS rk_loan FROM v_raw_payroll")
add("derived_secure20_fields", lambda v: v("raw_payroll").select("emp_no", parse_flag(F.col("hce_flag")).alias("is_hce"), F.lit(0.0).alias("catchup_pretax"), F.lit(0.0).alias("catchup_roth")),
    _RAW + f" SELECT emp_no, {_FLAG} AS is_hce, 0.0::DOUBLE AS catchup_pretax, 0.0::DOUBLE AS catchup_roth FROM v_raw_payroll")
add("cleaned_scalars", lambda v: v("raw_payroll").select("emp_no", "paid", *[f(F.col(c)).alias(f"{n}_{c}") for c in ("def_amount", "roth_amount", "loan_amount") for n, f in (("amount", parse_amount), ("number", numeric))],
    parse_date(F.col("hce_flag")).alias("no_date"), parse_flag(F.col("hce_flag")).alias("flag"), parse_flag(F.col("loan_amount")).alias("number_flag")),
    _RAW + " SELECT emp_no, paid, " + ", ".join(f"{_AMOUNT.format(c=c)} AS amount_{c}, coalesce(TRY_CAST(trim({c}) AS DOUBLE), 0) AS number_{c}" for c in ("def_amount", "roth_amount", "loan_amount"))
    + f", CAST(NULL AS DATE) AS no_date, {_FLAG} AS flag, coalesce(TRY_CAST(loan_amount AS DOUBLE) <> 0, false) AS number_flag FROM v_raw_payroll")
add("census_dates", lambda v: v("census").select("employee_id", age_on(F.col("dob"), F.col("hire_date")).alias("age"), age_rounded(F.col("dob"), F.col("hire_date")).alias("rounded_age"),
    first_of_month(F.col("hire_date")).alias("entry"), years_after(F.col("hire_date"), 1).alias("a_year_on"), calendar_days(F.col("hire_date"), F.col("termination_date")).alias("days_employed"), dollars(F.col("compensation")).alias("paid")),
    view_sql("census") + """ SELECT employee_id, CAST(trunc((hire_date - dob) / 365.25::DOUBLE) AS INTEGER) AS age, CAST(trunc(round_even((hire_date - dob) / 365.25::DOUBLE, 1)) AS INTEGER) AS rounded_age,
CAST(CASE WHEN day(hire_date) = 1 THEN hire_date ELSE date_trunc('month', hire_date) + INTERVAL 1 MONTH END AS DATE) AS entry, CAST(hire_date + INTERVAL 1 YEAR AS DATE) AS a_year_on,
CAST(greatest(termination_date - hire_date, CASE WHEN termination_date IS NOT NULL THEN 0 END) AS INTEGER) AS days_employed, '$' || CAST(compensation AS VARCHAR) AS paid FROM v_census""")
add("preflight_coverage", lambda v: preflight.coverage(v("raw_payroll"), "emp_no"), _RAW + """, c AS (SELECT count(*) AS total_rows, count(*) FILTER (coalesce(trim(emp_no) <> '', false)) AS rows_with_id FROM v_raw_payroll)
SELECT *, round(CASE WHEN total_rows > 0 THEN rows_with_id * 100.0::DOUBLE / total_rows ELSE 0 END, 4) AS coverage_pct FROM c""")
add("rk_pivot_money_type", lambda v: files.pivot_money_types(v("money_types")), view_sql("money_types") + """ SELECT employee_id, deposit_date, CAST(coalesce(sum(amount) FILTER (money_type = '457b_Pretax'), 0) AS DOUBLE) AS pretax,
CAST(coalesce(sum(amount) FILTER (money_type = '457b_Roth'), 0) AS DOUBLE) AS roth, 0.0::DOUBLE AS loan FROM v_money_types GROUP BY employee_id, deposit_date""")

# Integrity.
_HASHED = _JOINED.rstrip() + """, rh AS (SELECT employee_id, sha256('amount_payroll=' || coalesce(CAST(deferral_payroll AS VARCHAR), 'nan') || '|amount_rk=' || coalesce(CAST(deferral_rk AS VARCHAR), 'nan') || '|deposit_date=' ||
coalesce(CAST(deposit_date AS VARCHAR), 'nan') || '|employee_id=' || employee_id || '|pay_date=' || coalesce(CAST(pay_date AS VARCHAR), 'nan')) AS row_hash FROM g) """


def _hashable(v: Callable) -> DataFrame:
    return reconcile.stream(_joined(v), "deferrals").select("employee_id", "amount_payroll", "pay_date", "amount_rk", "deposit_date")


add("row_hashes", lambda v: integrity.row_hashes(_hashable(v)).select("employee_id", "row_hash"), _HASHED + "SELECT * FROM rh")
add("row_hash_sample", lambda v: integrity.sample_hashes(_hashable(v), "employee_id"), _HASHED + "SELECT row_number() OVER (ORDER BY employee_id) - 1 AS index_, row_hash FROM rh ORDER BY employee_id LIMIT 5")
add("merkle_root", lambda v: integrity.merkle_of(_hashable(v), "employee_id"), _HASHED.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """, lv AS (SELECT 0 AS depth, row_number() OVER (ORDER BY employee_id) - 1 AS i, row_hash AS h FROM rh
UNION ALL SELECT DISTINCT depth, i, h FROM (SELECT depth + 1 AS depth, i // 2 AS i, sha256(first_value(h) OVER w || last_value(h) OVER w) AS h, count(*) OVER (PARTITION BY depth) AS n FROM lv
WINDOW w AS (PARTITION BY depth, i // 2 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE n > 1) SELECT h AS merkle_root FROM lv WHERE depth = (SELECT max(depth) FROM lv)""")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["recon_deferrals"](spark, sf_dir)
