"""Headers to canonical columns: rules over a list of names, applied as one projection. No job runs."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

from pyspark.sql import DataFrame

from ledgerlane.functions import fixed


def key(name: str) -> str:
    return re.sub(r"\s+", "_", name.strip().lower())


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renames headers; when two would get one name, or the name exists, the first keeps it."""
    taken = {c for c in df.columns if c not in names}
    use: dict[str, str] = {}
    for c in df.columns:
        if c in names and names[c] not in taken:
            use[c] = names[c]
            taken.add(names[c])
    return df.withColumnsRenamed(use)


def left_aside(columns: list[str], names: dict[str, str]) -> list[tuple[str, str]]:
    """(header, name) of the headers that renamed() leaves as they are."""
    taken, out = {c for c in columns if c not in names}, []
    for c in columns:
        if c in names:
            if names[c] in taken and names[c] != c:
                out.append((c, names[c]))
            taken.add(names[c])
    return out


def amount_headers(columns: list[str]) -> dict[str, str]:
    """Header variants of the deferral and Roth amounts."""
    return {
        c: "EE Deferral $" if key(c) in fixed.DEFERRAL_HEADERS else "EE Roth $"
        for c in columns if key(c) in fixed.DEFERRAL_HEADERS + fixed.ROTH_HEADERS
    }


#: Aliases, first rule that holds wins: the name, whole headers, and a test of the bare header.
_ALIASES = (
    *[(name, whole, None) for name, whole in fixed.WHOLE_HEADERS.items()],
    ("employee_id", (), lambda k: _any(k, *fixed.ID_TOKENS)),
    ("pay_date", (), lambda k: _any(k, *fixed.PAY_DATE_TOKENS)),
    ("def_amount", (), lambda k: "deferral" in k and _any(k, "ee", "employee", "pretax") or k.startswith("deferralamount") or "pretax" in k and "def" in k),
    ("roth_amount", (), lambda k: "roth" in k and _any(k, "ee", "employee", "def")),
    ("loan_amount", (), lambda k: "loan" in k and _any(k, *fixed.LOAN_TOKENS)),
    ("deposit_date", (), lambda k: "deposit" in k and "date" in k),
    ("amount", (), lambda k: "total" in k and "deposit" in k and "amount" in k),
)


def _any(text: str, *tokens: str) -> bool:
    return any(t in text for t in tokens)


def alias_of(header: str) -> str | None:
    whole, bare = header.strip().lower(), re.sub(r"[\s$%#\-/]+", "", header.strip().lower())
    for name, exact, test in _ALIASES:
        if whole in exact or test and test(bare):
            return name
    return None


def aliases(columns: list[str]) -> dict[str, str]:
    """Headers with an alias whose name isn't there already."""
    return {c: a for c in columns if (a := alias_of(c)) and a not in columns}


def candidates(columns: list[str], wanted: dict[str, list[str]] = fixed.CANDIDATES) -> dict[str, str]:
    """Logical column to the header of its first candidate that is there."""
    there = {c.lower().strip(): c for c in columns}
    return {k: there[h] for k, names in wanted.items() if (h := next((n.lower().strip() for n in names if n.lower().strip() in there), None))}


def logical_columns(columns: list[str], vendor: str | None, strict: dict[str, dict]) -> dict[str, str]:
    """A vendor's strict map if all it requires is there, filled up by candidates; else candidates."""
    generic = candidates(columns)
    own = strict.get(vendor or "")
    if not own:
        return generic
    required = candidates(columns, own["required"])
    if len(required) < len(own["required"]):
        return generic
    return generic | candidates(columns, own["optional"]) | required


def _alike(a: str, b: str) -> float:
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def _occurs(keyword: str, columns: list[str]) -> bool:
    """Keyword in a header or a header in the keyword, plain or with underscores."""
    return any(w in c or c in w for w, cs in ((key(keyword), map(key, columns)), (keyword.lower(), [c.lower() for c in columns])) for c in cs)


def confidence(columns: list[str], vendor: str, vendors: dict) -> float:
    """0.4 of keywords found, 0.4 of the mean best likeness of columns, 0.2 of the number of columns."""
    if vendor not in vendors:
        return 0.0
    keywords, variants = vendors[vendor]
    found = sum(_occurs(k, columns) for k in keywords) / len(keywords)
    best = [max((_alike(key(v), key(c)) for v in names for c in columns), default=0.0) for names in variants.values()]
    score = 0.4 * found + 0.4 * sum(best) / len(best) + 0.2 * min(1.0, len(columns) / max(len(variants), 5))
    return min(1.0, max(0.0, score))


def detect_vendor(columns: list[str], vendors: dict, hint: str | None = None) -> tuple[str, float]:
    """The vendor with all its keywords among the headers and the greatest confidence. A hint names
    the vendor; one that isn't known keeps the confidence of the detected."""
    if hint in vendors:
        return hint, confidence(columns, hint, vendors)
    name, best = fixed.UNKNOWN_VENDOR, 0.0
    for vendor, (keywords, _) in vendors.items():
        if all(_occurs(k, columns) for k in keywords) and (c := confidence(columns, vendor, vendors)) > best:
            name, best = vendor, c
    return hint or name, best


def detect_vendors(payroll: list[str], rk: list[str], payroll_hint: str | None = None, rk_hint: str | None = None) -> dict:
    """Both sides' vendors; without headers on either side nothing is detected."""
    if not payroll or not rk:
        return {"payroll": (fixed.UNKNOWN_VENDOR, 0.0), "rk": (fixed.UNKNOWN_VENDOR, 0.0)}
    return {"payroll": detect_vendor(payroll, fixed.PAYROLL_VENDORS, payroll_hint), "rk": detect_vendor(rk, fixed.RK_VENDORS, rk_hint)}


def vendor_headers(columns: list[str], vendor: str, vendors: dict, least: float = 0.6) -> dict[str, str]:
    """Header to canonical column of a vendor: an exact variant, else the most alike from `least` on."""
    out: dict[str, str] = {}
    for canonical, variants in vendors.get(vendor, ([], {}))[1].items():
        best, how = None, 0.0
        for v in map(key, variants):
            same = [c for c in columns if key(c) == v]
            if same:
                best, how = same[0], 1.0
                continue
            for c in columns:
                like = _alike(v, key(c))
                if like > how and like >= least:
                    best, how = c, like
        if best is not None and best not in out:
            out[best] = canonical
    return out


def name_columns(columns: list[str]) -> dict[str, str]:
    """first_name and last_name: the first header that contains the word."""
    return {c: n for n, word in (("first_name", "first"), ("last_name", "last")) for c in [next((c for c in columns if word in c.lower()), None)] if c}


def id_column(columns: list[str]) -> str | None:
    named = {c.lower(): c for c in columns}
    for want in fixed.ID_COLUMNS:
        if want in named:
            return named[want]
    return next((c for c in columns if "employee" in c.lower() or c.lower().endswith("id")), None)


def lag_column(columns: list[str]) -> str | None:
    return next((c for c in columns if "lag" in c.lower()), None)


def has_amount_header(columns: list[str]) -> bool:
    """Whether a recordkeeper file's headers name any amount."""
    return any(_any(c.lower(), *fixed.AMOUNT_TOKENS) for c in columns)
