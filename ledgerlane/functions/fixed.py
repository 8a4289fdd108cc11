"""Fixed values of the domain: they must be these for results to be right."""

# Issue types: category, severity, correction hint.
ISSUES = {
    "HCE catch-up not coded as Roth": (
        "Secure 2.0", "High",
        "Review HCE catch-up contribution configuration and ensure all HCE catch-up amounts are coded as Roth contributions per Secure 2.0 requirements. Coordinate with payroll and recordkeeper to correct source coding and consult plan document provisions as needed.",
    ),
    "Potential catch-up coded in base deferral source": (
        "Secure 2.0", "Medium",
        "Review payroll source mapping to confirm catch-up contributions are tracked in a separate source from base deferrals. Recode catch-up dollars into the appropriate catch-up source to ensure proper tracking and compliance.",
    ),
    "Late start after eligibility": (
        "Eligibility", "High",
        "Confirm eligibility tracking and enrollment processes. Make participants whole for missed deferrals and employer match where appropriate under plan provisions and EPCRS correction procedures.",
    ),
    "No contributions after eligibility": (
        "Eligibility", "High",
        "Review participant enrollment and eligibility tracking. Confirm whether participant should have been enrolled and make participants whole for missed deferrals and match where appropriate under plan provisions and EPCRS correction procedures.",
    ),
    "402(g) excess deferrals": (
        "Comp/402(g)", "High",
        "Review year-to-date deferrals against IRS 402(g) limits. Process corrective distribution of excess deferrals (and associated earnings) by the applicable deadline to avoid plan disqualification. Adjust future payroll deferrals to stay within limits.",
    ),
    "Under-match": (
        "Match", "High",
        "Reconcile employer match calculations against plan formula and participant deferrals. Correct any under-credited match amounts and adjust ongoing match calculations to ensure compliance with plan provisions.",
    ),
    "Over-match": (
        "Match", "Medium",
        "Identify the cause of over-credited employer match. Coordinate with employer and recordkeeper to determine appropriate correction steps, which may include adjusting future match calculations or processing corrective distributions where applicable.",
    ),
}
DEFAULT_ISSUE = (
    "Other", "Medium",
    "Review this item with your TPA, recordkeeper, and plan document to determine the appropriate correction steps.",
)

# What to do about an issue, by type.
FIXES = {
    "HCE catch-up not coded as Roth": "Confirm Secure 2.0 HCE Roth requirement; reclassify HCE catch-up to Roth source if needed.",
    "Potential catch-up coded in base deferral source": "Review age 50+ deferrals to confirm whether catch-up amounts are tracked separately from base deferrals.",
    "No contributions after eligibility": "Review participant for missed eligibility; consider correction under plan rules and EPCRS.",
    "Late start after eligibility": "Review delayed start against plan provisions; consider eligibility correction if required.",
}
CATCHUP_DEMO_REASON = "HCE age 50+ with pre-tax deferrals and no Roth catch-up (demo rule)"

# Sources of issues and their categories where a row has none.
SOURCE_CATEGORY = {"secure20": "Secure 2.0", "eligibility": "Eligibility", "comp_402g": "Comp/402(g)", "match": "Match"}

# Weight of an issue in the plan-health score, by category.
WEIGHTS = {"Secure 2.0": 3, "Eligibility": 2, "Comp/402(g)": 3, "Match": 2, "Timing": 1, "Other": 1}

# Annual limits: year, base, catch-up. Other years use the latest.
LIMITS = {2023: (22500, 7500), 2024: (23000, 7500)}

# Tokens of flags.
TRUE_TOKENS = ("true", "1", "yes", "y")
FALSE_TOKENS = ("false", "0", "no", "n")

# Headers of census dates.
CENSUS_DATES = {"dob": ("dob", "date_of_birth", "birth_date", "Date of Birth"), "hire_date": ("hire_date",), "termination_date": ("termination_date",)}

# Headers that mean the deferral or Roth amount, after lower-casing and white space to underscores.
DEFERRAL_HEADERS = ("def_amount", "employee_deferral", "deferral", "ee_deferral", "contribution_amount", "pretax", "employee_pre_tax", "ee_pretax_def")
ROTH_HEADERS = ("roth_amount", "roth_deferral", "roth", "roth_contribution", "ee_roth_def")

# Candidate headers by logical column, first match wins; case and outer white space do not count.
CANDIDATES = {
    "employee_id": ["employee_id", "employee id", "ee id", "emp id", "empid", "empnumber", "employee_number", "participant id", "participant_id", "participant", "part_id"],
    "pay_date": ["pay_date", "pay date", "payroll date", "check date", "checkdt", "payroll_run_date", "pay period end date", "pay period date", "date"],
    "deposit_date": ["deposit_date", "deposit date", "recordkeeper date", "trade date", "post_date", "posting date", "funding date", "contribution date", "transaction_effective_date"],
    "payroll_pretax": ["pretax_defl", "ee deferral $", "ee deferral", "EE Deferral $", "employee contribution", "pre-tax", "pre tax", "amount", "457b_ee_pretax_amt", "ee_pretax_def", "payroll_pretax"],
    "payroll_roth": ["roth_defl", "ee roth $", "ee roth", "EE Roth $", "roth contribution", "roth", "457b_ee_roth_amt", "ee_roth_def", "payroll_roth"],
    "payroll_loan": ["loan_pmt", "loan repay $", "loan repayment", "457b_loan_repay_amt", "loan_repayment"],
    "is_hce": ["is_hce", "is hce", "hce_flag", "hce flag", "hce", "highly_compensated", "highly compensated", "highly compensated employee"],
    "catchup_pretax": ["catchup_pretax", "catchup pretax", "catch_up_pretax", "catch up pretax", "pretax catchup", "pretax catch-up", "catchup_contribution_pretax"],
    "catchup_roth": ["catchup_roth", "catchup roth", "catch_up_roth", "catch up roth", "roth catchup", "roth catch-up", "catchup_contribution_roth"],
    "rk_pretax": ["ee_pretax", "ee deferral $", "ee deferral", "EE Deferral $", "employee contribution", "pre-tax cont", "pre tax cont", "pre-tax", "amount", "ee_pretax_def"],
    "rk_roth": ["ee_roth", "ee roth $", "ee roth", "EE Roth $", "roth contribution", "roth cont", "roth", "ee_roth_def"],
    "rk_loan": ["loan_contr", "loan repayment", "loan_repayment"],
    "amount": ["amount", "deferral", "ee deferral $", "deposit amount", "employee contribution", "pre-tax cont", "roth cont", "contribution_amount", "total_deposit_amount"],
}

# Strict column maps of vendors: all required present, else the candidates above.
PAYROLL_STRICT = {
    "ADP": {
        "required": {"employee_id": ["EE ID"], "pay_date": ["Check Date"], "payroll_pretax": ["EE Deferral $"], "payroll_roth": ["EE Roth $"], "payroll_loan": ["Loan Repay $"]},
        "optional": {"amount": ["EE Deferral $"], "is_hce": ["Is_HCE", "HCE_Flag", "Highly_Compensated"], "catchup_pretax": ["Catchup_Pretax", "Catch_Up_Pretax"], "catchup_roth": ["Catchup_Roth", "Catch_Up_Roth"]},
    },
}
RK_STRICT = {
    "VENDOR_RK_1": {
        "required": {"employee_id": ["Participant ID"], "deposit_date": ["Trade Date"], "rk_pretax": ["Employee Contribution"], "rk_roth": ["Roth Contribution"], "rk_loan": ["Loan Repayment"]},
        "optional": {"amount": ["Employee Contribution"]},
    },
}

# Vendors: keywords that must all occur among the headers, and header variants by canonical column.
PAYROLL_VENDORS = {
    "ADP": (
        ["emp id", "check date", "ee deferral", "ee roth"],
        {"employee_id": ["emp id", "employee_id", "emp_id", "employee number"], "pay_date": ["check date", "pay date", "payroll date", "check_date"], "EE Deferral $": ["ee deferral", "ee deferral $", "deferral", "pretax deferral"], "EE Roth $": ["ee roth", "ee roth $", "roth deferral", "roth"], "loan_amount": ["loan repay", "loan payment", "loan repay $"]},
    ),
    "Paychex": (
        ["employee number", "pay period end", "401k deferral", "roth 401k"],
        {"employee_id": ["employee number", "emp number", "employee_id"], "pay_date": ["pay period end", "pay date", "check date"], "EE Deferral $": ["401k deferral", "pretax deferral", "deferral amount"], "EE Roth $": ["roth 401k", "roth deferral", "roth amount"], "loan_amount": ["loan repayment", "loan payment"]},
    ),
    "Paylocity": (
        ["employee id", "pay date", "pretax", "roth contribution"],
        {"employee_id": ["employee id", "employee_id", "emp id"], "pay_date": ["pay date", "payroll date", "check date"], "EE Deferral $": ["pretax", "pretax deferral", "401k pretax"], "EE Roth $": ["roth contribution", "roth deferral", "401k roth"], "loan_amount": ["loan payment", "loan repayment"]},
    ),
    "QuickBooks": (
        ["employee", "payroll date", "401k employee", "401k roth"],
        {"employee_id": ["employee", "employee id", "employee_id"], "pay_date": ["payroll date", "pay date", "check date"], "EE Deferral $": ["401k employee", "401k pretax", "deferral"], "EE Roth $": ["401k roth", "roth 401k", "roth"], "loan_amount": ["loan", "loan payment"]},
    ),
    "Workday": (
        ["worker id", "pay period end", "pretax contribution", "roth contribution"],
        {"employee_id": ["worker id", "employee id", "worker_id"], "pay_date": ["pay period end", "pay date", "period end date"], "EE Deferral $": ["pretax contribution", "pretax", "401k pretax"], "EE Roth $": ["roth contribution", "roth", "401k roth"], "loan_amount": ["loan payment", "loan repayment"]},
    ),
    "UKG": (
        ["employee number", "pay date", "pretax deferral", "roth deferral"],
        {"employee_id": ["employee number", "emp number", "employee_id"], "pay_date": ["pay date", "payroll date", "check date"], "EE Deferral $": ["pretax deferral", "pretax", "401k pretax"], "EE Roth $": ["roth deferral", "roth", "401k roth"], "loan_amount": ["loan payment", "loan repayment"]},
    ),
    "BambooHR": (
        ["employee id", "pay date", "401k pretax", "401k roth"],
        {"employee_id": ["employee id", "employee_id", "emp id"], "pay_date": ["pay date", "payroll date", "check date"], "EE Deferral $": ["401k pretax", "pretax", "pretax deferral"], "EE Roth $": ["401k roth", "roth", "roth deferral"], "loan_amount": ["loan payment", "loan repayment"]},
    ),
    "TriNet": (
        ["employee id", "pay period end", "pretax 401k", "roth 401k"],
        {"employee_id": ["employee id", "employee_id", "emp id"], "pay_date": ["pay period end", "pay date", "payroll date"], "EE Deferral $": ["pretax 401k", "pretax", "401k pretax"], "EE Roth $": ["roth 401k", "roth", "401k roth"], "loan_amount": ["loan payment", "loan repayment"]},
    ),
}
RK_VENDORS = {
    "VENDOR_RK_1": (
        ["part_id", "post_date", "ee_pretax", "ee_roth"],
        {"employee_id": ["part_id", "participant id", "employee_id"], "deposit_date": ["post_date", "post date", "deposit date"], "EE Deferral $": ["ee_pretax", "ee pretax", "pretax contribution"], "EE Roth $": ["ee_roth", "ee roth", "roth contribution"], "loan_amount": ["loan_contr", "loan contribution", "loan payment"]},
    ),
    "Fidelity": (
        ["participant id", "transaction date", "pretax contribution", "roth contribution"],
        {"employee_id": ["participant id", "employee id", "participant_id"], "deposit_date": ["transaction date", "deposit date", "post date"], "EE Deferral $": ["pretax contribution", "pretax", "401k pretax"], "EE Roth $": ["roth contribution", "roth", "401k roth"], "loan_amount": ["loan contribution", "loan payment"]},
    ),
    "Vanguard": (
        ["participant id", "transaction date", "pretax", "roth"],
        {"employee_id": ["participant id", "employee id", "participant_id"], "deposit_date": ["transaction date", "deposit date", "post date"], "EE Deferral $": ["pretax", "pretax contribution", "401k pretax"], "EE Roth $": ["roth", "roth contribution", "401k roth"], "loan_amount": ["loan", "loan contribution"]},
    ),
}
UNKNOWN_VENDOR = "Unknown / Generic"

# Whole headers by canonical name, and what headers of ids and amounts hold.
WHOLE_HEADERS = {
    "def_amount": ("ee deferral $", "ee deferral", "employee deferral $", "ee_pretax_def", "ee pretax def"),
    "roth_amount": ("ee roth $", "ee roth", "employee roth $", "ee_roth_def", "ee roth def"),
    "pay_date": ("pay date", "payroll date", "pay period end date", "pay period ending", "check date", "payroll run date", "pay_date"),
    "deposit_date": ("deposit_date", "deposit date"),
    "amount": ("total_deposit_amount", "total deposit amount"),
}
ID_TOKENS = ("employeeid", "empid", "employeenumber", "empnumber", "emplid", "participantid")
ID_COLUMNS = ("employee_id", "empnumber", "part_id", "emp_id", "participant_id")
AMOUNT_TOKENS = ("deferral", "pretax", "pre-tax", "roth", "loan", "amount", "contribution", "match")

# Parts of headers by canonical name, after lower-casing and without white space, $, %, #, - and /.
PAY_DATE_TOKENS = ("paydate", "checkdate", "payperiodend")
LOAN_TOKENS = ("repaid", "repayment", "payment", "pmt", "amount")

# Compliance metrics: category, metric, notes.
METRICS = (
    ("Late Contributions", "Late deferral rows", "Count of rows flagged as late for deferrals"),
    ("Late Contributions", "Late loan rows", "Count of rows flagged as late for loans"),
    ("Late Contributions", "Unique employees with any late event", "Across deferrals and loans"),
    ("Late Contributions", "Max business-day lag (late rows only)", ""),
    ("Late Contributions", "Average business-day lag (late rows only)", ""),
    ("Mismatches", "Deferral mismatch rows", "Rows where payroll vs RK deferral amounts differ"),
    ("Mismatches", "Loan mismatch rows", "Rows where payroll vs RK loan amounts differ"),
    ("Mismatches", "Unique employees with any mismatch", ""),
    ("Coverage", "Only-in-payroll deferral rows", "Payroll has row; RK is missing it (deferrals)"),
    ("Coverage", "Only-in-recordkeeper deferral rows", "RK has row; payroll is missing it (deferrals)"),
    ("Coverage", "Only-in-payroll loan rows", "Payroll has row; RK is missing it (loans)"),
    ("Coverage", "Only-in-recordkeeper loan rows", "RK has row; payroll is missing it (loans)"),
)
