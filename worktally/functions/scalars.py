"""Row-level expressions.

Missing-value rules differ from plain SQL in a few places; every rule that
matters is a named helper here so that no pipeline restates it by hand.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- null rules
def later_of(a: Column | str, b: Column | str) -> Column:
    """Larger of two values; missing when either one is missing."""
    a, b = as_col(a), as_col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def if_else(cond: Column, yes: Column, no: Column) -> Column:
    """Two-way choice whose result is missing when the condition is missing."""
    return F.when(cond, yes).when(~cond, no)


def in_set(c: Column | str, values: Iterable) -> Column:
    """Membership that is never missing: a missing value is in no set."""
    return F.coalesce(as_col(c).isin(list(values)), F.lit(False))


def zero_to_null(c: Column | str) -> Column:
    """Keep positive numbers, blank out the rest."""
    c = as_col(c)
    return F.when(c > 0, c)


def null_to_zero(c: Column | str) -> Column:
    return F.coalesce(as_col(c), F.lit(0.0))


def null_if(c: Column | str, values: Iterable) -> Column:
    """Turn the listed placeholder values into missing."""
    c = as_col(c)
    return F.when(~in_set(c, values), c)


def coalesce_first(*cols: Column | str) -> Column:
    return F.coalesce(*[as_col(c) for c in cols])


def clamp_zero(c: Column | str, keep_missing: bool = False) -> Column:
    """No less than zero. Missing becomes zero unless ``keep_missing``."""
    c = as_col(c)
    clamped = F.greatest(F.lit(0.0), c)
    return F.when(c.isNotNull(), clamped) if keep_missing else clamped


# --------------------------------------------------------------------- dates
def month_start(d: Column | str) -> Column:
    return F.trunc(as_col(d), "MM")


def fiscal_year(d: Column | str, first_month: int = 6) -> Column:
    """Calendar year in which the fiscal year of ``d`` began (June by default)."""
    return F.year(F.add_months(as_col(d), 1 - first_month))


def weekday_label(d: Column | str) -> Column:
    return F.date_format(as_col(d), "E")


def weekday_order(d: Column | str) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(as_col(d))


def week_days(monday: Column | str) -> Column:
    """Array of the seven dates that start at ``monday``."""
    monday = as_col(monday)
    return F.sequence(monday, F.date_add(monday, 6))


def remap_month(d: Column | str, month: str, to: str) -> Column:
    """Move every date of one month (``yyyy-mm-01``) to one fixed date."""
    d = as_col(d)
    return if_else(F.trunc(d, "MM") == F.lit(month).cast("date"), F.lit(to).cast("date"), d)


# ------------------------------------------------------------------ rounding
def round_half_even(c: Column | str, digits: int = 0) -> Column:
    return F.bround(as_col(c), digits)


def round_half_up(c: Column | str, digits: int = 0) -> Column:
    """Halves go away from zero."""
    return F.round(as_col(c), digits)


def rounder(rounding: str):
    """Rounding expression by name: ``half even`` or ``half up``."""
    choices = {"half even": round_half_even, "half to even": round_half_even, "half up": round_half_up}
    if rounding not in choices:
        raise ValueError(f"rounding must be one of {sorted(choices)}, not {rounding!r}")
    return choices[rounding]


def signif_half_up(c: Column | str, digits: int = 6) -> Column:
    """Round to a number of significant digits, halves away from zero."""
    c = as_col(c).cast("double")
    exponent = F.floor(F.log10(F.abs(c))).cast("int")
    # A power of ten at or above one keeps the scaling itself exact.
    up = F.pow(F.lit(10.0), F.greatest(F.lit(digits - 1) - exponent, F.lit(0)))
    down = F.pow(F.lit(10.0), F.greatest(exponent - F.lit(digits - 1), F.lit(0)))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c * up / down, 0) / up * down)


def round_to_fraction(c: Column | str, denominator: float, digits: int | None = None) -> Column:
    """Nearest multiple of ``1/denominator``, optionally rounded again."""
    snapped = F.round(as_col(c) * F.lit(float(denominator)), 0) / F.lit(float(denominator))
    return snapped if digits is None else F.round(snapped, digits)


# ---------------------------------------------------------------------- text
def paste(*cols: Column | str, sep: str = " ") -> Column:
    """Join as text; a missing part prints as ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(as_col(c).cast("string"), F.lit("NA")) for c in cols])


def first_letters(c: Column | str) -> Column:
    """First unbroken run of ASCII letters, missing when there is none."""
    return F.nullif(F.regexp_extract(as_col(c), "[A-Za-z]+", 0), F.lit(""))


def pad_cell(c: Column | str, default: str = " - ") -> Column:
    """Number for a printed table: one decimal, ties to even, dash when missing."""
    c = as_col(c)
    return F.when(c.isNull(), F.lit(default)).otherwise(F.format_string("%.1f", F.bround(c, 1)))


def format_count(c: Column | str, big_mark: str = ",") -> Column:
    """Whole number with a thousands mark."""
    text = F.format_number(as_col(c), 0)
    return text if big_mark == "," else F.replace(text, F.lit(","), F.lit(big_mark))


def format_share(c: Column | str, digits: int = 1, rounding: str = "half even", affix: bool = True) -> Column:
    """Share as percent text such as ``12.3%``; no thousands mark."""
    percent = rounder(rounding)(as_col(c) * 100, digits)
    text = F.format_string(f"%.{digits}f", percent)
    if affix:
        text = F.concat(text, F.lit("%"))
    return F.when(as_col(c).isNull(), F.lit("-")).otherwise(text)
