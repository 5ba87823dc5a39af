"""From raw work entries to charges, project ranges and week skeletons.

Every function takes ``by``, extra key columns such as ``person`` that are put
in front of each group and join key; the default is one person's feed.

Charges come in two grains. ``prepare_charges`` keeps one row per work entry.
``charge_ledger`` first adds up entries that agree in everything but hours,
with the number of entries ``n`` and of missing hours ``missing``. All pipelines
accept both and give equal results; the ledger leaves the raw rows behind in
the first map-side aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktally.functions.scalars import fiscal_year, later_of, month_start
from worktally.operators.cleaning import drop_missing, fill_const, fill_with_max, nan_to_null, quality_gate
from worktally.operators.fill import fill_down
from worktally.operators.joins import join_null_safe, union_feeds, validity_join
from worktally.session import stored

WEEK = ["year", "month", "period"]


def type_charges(
    raw: DataFrame,
    by: Sequence[str] = (),
    keys: Sequence[str] = ("project", "code"),
    need_hours: bool = True,
) -> DataFrame:
    """Dates typed, entry moved into the charged week, month and fiscal year added."""
    dated = drop_missing(nan_to_null(raw), ["date", "hours"] if need_hours else ["date"])
    date, period = F.to_date("date"), F.to_date("period")
    dated = dated.withColumns({"date": later_of(date, period), "period": period})
    return dated.select(
        *by,
        fiscal_year("date").alias("year"),
        month_start("date").alias("month"),
        "period",
        "date",
        *keys,
        F.col("hours").cast("double").alias("hours"),
        F.col("length").cast("double").alias("length"),
    )


def prepare_charges(raw: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(charges, rejected entries): codes filled down per project, gaps rejected."""
    filled = fill_down(type_charges(raw, by), "code", [*by, "project"])
    return quality_gate(filled, ["project", "code"])


def with_counts(charges: DataFrame) -> DataFrame:
    """Entry-level charges in ledger form: each row stands for one entry."""
    if "n" in charges.columns:
        return charges
    return charges.withColumns({"n": F.lit(1).cast("bigint"), "missing": F.col("hours").isNull().cast("bigint")})


def collapse(charges: DataFrame) -> DataFrame:
    """Add up entries that agree in every column but hours."""
    keys = [c for c in charges.columns if c not in ("hours", "n", "missing")]
    return (
        with_counts(charges)
        .groupBy(*keys)
        .agg(F.sum("hours").alias("hours"), F.sum("n").alias("n"), F.sum("missing").alias("missing"))
    )


def charge_ledger(raw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accepted charges of ``prepare_charges``, collapsed before any other work.

    The raw feed is read once: filling reads the stored, collapsed entries.
    Year and month follow from the date and are added at the end.
    """
    typed = type_charges(raw, by)
    entries = stored(collapse(typed.drop("year", "month")), "entries")
    good, _ = quality_gate(fill_down(entries, "code", [*by, "project"]), ["project", "code"])
    good = good.withColumns({"year": fiscal_year("date"), "month": month_start("date")})
    return good.select(*typed.drop("hours").columns, "hours", "n", "missing")


def plan_ledger(raw: DataFrame, by: Sequence[str] = (), need_hours: bool = True) -> DataFrame:
    """Collapsed charges keyed by project and subproject, for plan-sheet pipelines."""
    return collapse(type_charges(raw, by, ("project", "subproject"), need_hours))


def strict_hours(cond: Column | None = None) -> Column:
    """Sum of ledger hours that is missing when any entry had no hours."""
    hours, missing = F.col("hours"), F.col("missing")
    if cond is not None:
        hours, missing = F.when(cond, hours), F.when(cond, missing)
    return F.when(F.sum(missing) == 0, F.sum(hours))


# ------------------------------------------------------------------- projects
def derive_projects(charges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First and last date of each (year, project, code) seen in the charges."""
    return charges.groupBy(*by, "year", "project", "code").agg(
        F.min("date").alias("startdate"), F.max("date").alias("enddate")
    )


def prepare_projects(plan: DataFrame, default_year: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Plan sheet typed: open plans end with the latest one (of their ``by`` group), subcode never missing."""
    typed = nan_to_null(plan).withColumns(
        {
            "year": F.col("year").cast("int"),
            "startdate": F.to_date("startdate"),
            "enddate": F.to_date("enddate"),
            "subcode": F.col("subcode").cast("string"),
            "budgeted": F.col("budgeted").cast("double"),
        }
    )
    typed = fill_const(fill_with_max(typed, "enddate", by), {"subcode": ""})
    return typed if default_year is None else fill_const(typed, {"year": default_year})


# --------------------------------------------------------------- week skeleton
def charged_weeks(charges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct weeks with their month and year; a calendar-sized table."""
    return charges.select(*by, *WEEK).distinct()


def _as_blank(weeks: DataFrame) -> DataFrame:
    return weeks.withColumns(
        {
            "date": F.col("period"),
            "hours": F.lit(0.0),
            "length": F.lit(None).cast("double"),
            "n": F.lit(1).cast("bigint"),
            "missing": F.lit(0).cast("bigint"),
        }
    )


def blank_weeks(
    charges: DataFrame, projects: DataFrame, by: Sequence[str] = (), keys: Sequence[str] = ("project", "code")
) -> DataFrame:
    """A zero-hour row for every charged week and every project of its year.

    The weeks, calendar-sized without ``by``, meet the projects in an inner join:
    Spark may broadcast them, and else split a year of many projects on either
    side. Weeks of years without projects are added.
    """
    members = projects.select(*by, "year", *keys)
    weeks = charged_weeks(charges, by)
    met = join_null_safe(members, weeks, [*by, "year"])
    unmet = join_null_safe(weeks, members.select(*by, "year").distinct(), [*by, "year"], "left_anti")
    return _as_blank(union_feeds(met, unmet).select(*by, *WEEK, *keys))


def combine(charges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Charges and blank weeks inside each project's own first and last date.

    Charges lie inside the range that was derived from them, so only the blanks
    are trimmed, while they are made; a self-join of the charges is not needed.
    A range lies in one fiscal year and meets the charged weeks of that year as one
    list, which is calendar-sized; neither ranges nor weeks are sent as one row for
    each pair. Charges are read three times here, so they are stored first.
    """
    charges = stored(charges, "charges")
    # One key that is never missing itself. The ledger of a group's year, added up before, is sent once to where all
    # of this is done; single entries and the years of a whole feed are added up map-side instead.
    keyed = charges.withColumn("__of", F.struct(*by, "year"))
    keyed = keyed.repartition("__of") if by and "n" in charges.columns else keyed
    weeks = charged_weeks(keyed, ["__of"]).groupBy("__of").agg(F.collect_list(F.struct("month", "period")).alias("__weeks"))
    met = derive_projects(keyed, ["__of"]).join(weeks, "__of").withColumn("__week", F.explode("__weeks"))
    met = met.filter(F.col("__week.period").between(F.col("startdate"), F.col("enddate")))
    blanks = _as_blank(met.select("__of.*", "__week.month", "__week.period", "project", "code"))
    return union_feeds(with_counts(charges).filter(F.col("date").isNotNull()), blanks)


def combine_with_plan(charges: DataFrame, projects: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Charges and blank weeks joined to the plan rows valid on their date.

    Several plan rows of one key each meet every row of that key, blanks
    included, as the plan sheet asks.
    """
    charges = stored(charges, "charges")
    keys = ["project", "subproject"]
    blanks = blank_weeks(charges, projects, by, keys)
    return validity_join(union_feeds(with_counts(charges), blanks), projects, [*by, "year", *keys])
