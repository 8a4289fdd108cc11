"""Column expressions of the domain; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlane.functions.fixed import FALSE_TOKENS, TRUE_TOKENS

MONEY = "decimal(18,2)"
DATE_FORMATS = ("M/d/yyyy", "M-d-yyyy", "yyyy/M/d", "yyyyMMdd", "M/d/yy")


def parse_amount(c: Column) -> Column:
    """Text to money: commas and dollar signs go, what cannot be read is 0."""
    plain = F.regexp_replace(F.trim(c.cast("string")), "[$,]", "")
    return F.coalesce(plain.try_cast("double").try_cast(MONEY), F.lit(0).cast(MONEY))


def numeric(c: Column) -> Column:
    """Text to double without stripping signs; what cannot be read is 0."""
    return F.coalesce(F.trim(c.cast("string")).try_cast("double"), F.lit(0.0))


def parse_date(c: Column) -> Column:
    """Text to date in ISO or one of DATE_FORMATS, else null."""
    s = F.trim(c.cast("string"))
    return F.coalesce(s.try_cast("date"), *[F.try_to_date(s, f) for f in DATE_FORMATS])


def parse_flag(c: Column) -> Column:
    """True for 1, y, yes, true or a number other than 0; anything unknown is false."""
    s = F.lower(F.trim(c.cast("string")))
    return F.coalesce(s.isin(*TRUE_TOKENS) | (s.try_cast("double") != 0), F.lit(False))


def unknown_flag(c: Column) -> Column:
    """Whether a flag is there but says neither yes nor no."""
    s = F.lower(F.trim(c.cast("string")))
    return F.coalesce((s != "") & ~s.isin(*TRUE_TOKENS, *FALSE_TOKENS) & s.try_cast("double").isNull(), F.lit(False))


def business_days(start: Column, end: Column) -> Column:
    """Weekdays in [start, end), without a holiday calendar; negative when end is before start."""

    def weekdays_before(d: Column) -> Column:
        n = F.datediff(d, F.lit("1900-01-01").cast("date"))  # a Monday
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))

    back = -(weekdays_before(F.date_add(start, 1)) - weekdays_before(F.date_add(end, 1)))
    return F.when(end >= start, weekdays_before(end) - weekdays_before(start)).when(end < start, back).cast("int")


def business_days_after(start: Column, days: Column) -> Column:
    """The date so many weekdays (0 or more) after start; a weekend counts as the Friday before it."""
    weekday = F.weekday(start)  # Monday is 0
    at = F.least(weekday, F.lit(4)) + days
    return F.date_add(F.date_sub(start, weekday), (F.floor(at / 5) * 7 + at % 5).cast("int"))


def calendar_days(start: Column, end: Column) -> Column:
    """Days from start to end, 0 at least, null if either is null."""
    days = F.datediff(end, start)
    return F.when(days.isNotNull(), F.greatest(days, F.lit(0)))


def age_on(born: Column, day: Column) -> Column:
    """Whole years of 365.25 days; -1 where unknown."""
    return F.coalesce((F.datediff(day, born) / 365.25).cast("int"), F.lit(-1))


def age_rounded(born: Column, day: Column) -> Column:
    """Years rounded half-even to one place, then cut to whole years."""
    return F.bround(F.datediff(day, born) / 365.25, 1).cast("int")


def first_of_month(d: Column) -> Column:
    """d if it is a first of a month, else the next first."""
    return F.when(F.dayofmonth(d) == 1, d).otherwise(F.add_months(F.trunc(d, "MM"), 1))


def years_after(d: Column, years: int) -> Column:
    return F.add_months(d, 12 * years)


def ratio(a: Column, b: Column) -> Column:
    """a / b, where a zero b counts as 1."""
    return a / F.when(b == 0, F.lit(1.0)).otherwise(b)


def dollars(c: Column) -> Column:
    """$ and two places, rounded half up from six."""
    exact = F.round(c.cast("double"), 6).try_cast("decimal(24,6)").try_cast("decimal(24,2)")
    return F.concat(F.lit("$"), exact.cast("string"))


def header_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", "_")


def once(value: Column) -> Column:
    """value as a column of its own that is computed once a row. The optimizer copies plain
    expressions into every filter and projection that reads them; it copies none through explode().
    One of these may stand in a projection."""
    return F.explode(F.array(value))
