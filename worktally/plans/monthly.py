"""Monthly hours and budgets per project, yearly totals, chart frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worktally.functions.aggregates import median_lenient, n_distinct, sum_lenient
from worktally.functions.scalars import (
    clamp_zero,
    first_letters,
    fiscal_year,
    if_else,
    in_set,
    month_start,
    paste,
    remap_month,
    round_half_even,
)
from worktally.operators.joins import attach_group, join_null_safe
from worktally.operators.quantiles import group_median
from worktally.operators.ranking import first_appearance_rank, share_scaling
from worktally.operators.reshape import complete, gather
from worktally.plans.charges import with_counts
from worktally.session import stored

# Project and total hours per month on an eight-hour day, the
# flat monthly target of the first budget rule and its seven-hour-day form.
PROJECT_HOURS = 119.0
MONTH_HOURS = 174.0
FULL_DAY = 8.0
FLAT_TARGET = 101.0
FLAT_DAY = 7.2

# Time that is not project time, and its joint label.
NON_PROJECT = ("Admin", "Learning", "Leave")
NON_PROJECT_LABEL = "NPT"
NO_CODE = "0"


def _month_lines(rows: DataFrame, by: Sequence[str], budgeted: bool) -> DataFrame:
    """One line per month and project2, gaps completed with zero hours.

    ``rows`` has month, project2, code2, hours, length, n and, if ``budgeted``,
    a budget per row. Everything after the first aggregate is calendar-sized
    per project.
    """
    weight = F.when(F.col("length").isNotNull(), F.col("n"))
    lengths = [F.sum(F.col("length") * F.col("n")).alias("__lengths"), F.sum(weight).alias("__weight")]
    code = F.max(F.coalesce("code2", F.lit(NO_CODE))).alias("code2")
    if by and not budgeted:
        # Groups are many and small: codes hardly repeat in a month, so one step sends each line once.
        parts = rows.groupBy(*by, "month", "project2").agg(sum_lenient("hours").alias("hours"), code, *lengths)
        sums = stored(parts, "months")
    else:
        # Text and budget are keys of the first step, which then only adds numbers and
        # is hashed map-side; maximum and median work on its short result.
        details = [*by, "month", "project2", "code2"] + (["budgeted"] if budgeted else [])
        parts = rows.groupBy(*details).agg(F.sum("hours").alias("hours"), F.sum("n").alias("n"), *lengths)
        measures = [sum_lenient("hours").alias("hours"), code, F.sum("__lengths").alias("__lengths"), F.sum("__weight").alias("__weight")]
        if budgeted:
            measures.append(median_lenient("budgeted", "n").alias("budgeted"))
        sums = stored(parts.groupBy(*by, "month", "project2").agg(*measures), "months")
    fill = {"hours": 0.0, "code2": NO_CODE}
    length = lambda window=None: F.try_divide(*[F.sum(c).over(window) if window else F.sum(c) for c in ("__lengths", "__weight")])
    if by:
        # Lines of a group and year are sent once, for the lengths of months and the codes of projects.
        lines = complete(sums, "project2", "month", by, fill).withColumn("year", fiscal_year("month")).repartition(*by, "year")
        lines = lines.withColumn("length", length(Window.partitionBy(*by, "year", "month"))).drop("__lengths", "__weight")
    else:
        lines = complete(sums.drop("__lengths", "__weight"), "project2", "month", by, fill).withColumn("year", fiscal_year("month"))
        lines = join_null_safe(lines, sums.groupBy("month").agg(length().alias("length")), ["month"], "left")
    # At most twelve months per group.
    one_year = Window.partitionBy(*by, "year", "project2")
    lines = lines.withColumn("code2", F.max("code2").over(one_year))
    shown = {
        "hours": clamp_zero("hours"),
        "profile": round_half_even(F.col("length") * PROJECT_HOURS / FULL_DAY),
        "project": first_letters("project2"),
    }
    if budgeted:
        shown["budgeted"] = clamp_zero("budgeted")
    budget = ["budgeted"] if budgeted else []
    return lines.withColumns(shown).select(
        *by, "year", "month", "length", "project2", "code2", *budget, "hours", "profile", "project"
    )


def monthly(combined: DataFrame, by: Sequence[str] = (), npt: Sequence[str] = NON_PROJECT) -> DataFrame:
    """Hours per month and project; non-project time is one line."""
    is_npt = in_set("project", npt)
    rows = with_counts(combined).withColumns(
        {
            "project2": if_else(is_npt, F.lit(NON_PROJECT_LABEL), F.col("project")),
            "code2": if_else(is_npt, F.lit(NON_PROJECT_LABEL), F.col("code")),
        }
    )
    return _month_lines(rows, by, budgeted=False)


def _scaled_down(lines: DataFrame, by: Sequence[str], counted: Column) -> DataFrame:
    """Budgets cut to the month's profile, never raised, one decimal."""
    lines = attach_group(
        lines,
        [*by, "month"],
        __sum=F.coalesce(F.sum(F.when(counted, F.col("budgeted"))), F.lit(0.0)),
        __profile=F.min("profile"),
    )
    scale = F.least(F.lit(1.0), F.coalesce(F.try_divide("__profile", "__sum"), F.lit(1.0)))
    scaled = F.when(F.col("__profile").isNull(), F.lit(0.0)).otherwise(F.col("budgeted") * scale)
    return lines.withColumn("budgeted2", round_half_even(clamp_zero(scaled), 1)).drop("__sum", "__profile")


def monthly_budget(
    combined: DataFrame, by: Sequence[str] = (), npt: Sequence[str] = NON_PROJECT, keep_npt: bool = True
) -> DataFrame:
    """Hours and budgets per month, project and subproject of the plan sheet.

    With ``keep_npt`` non-project time is one line whose budget is what a month
    leaves beside project hours; without it those projects are dropped. Either
    way they do not count towards the sum that is fitted to the profile.
    """
    rows = with_counts(combined)
    named = {"project2": paste("project", "subproject"), "code2": paste("code", "subcode")}
    if not keep_npt:
        lines = _month_lines(rows.withColumns(named), by, budgeted=True)
        lines = lines.filter(~in_set("project", npt))
        return _scaled_down(lines, by, F.lit(True))
    is_npt = in_set("project", npt)
    spare = F.col("length") / FULL_DAY * (MONTH_HOURS - PROJECT_HOURS)
    rows = rows.withColumns(
        {name: if_else(is_npt, F.lit(NON_PROJECT_LABEL), expr) for name, expr in named.items()}
        | {"budgeted": if_else(is_npt, spare, F.col("budgeted"))}
    )
    lines = _month_lines(rows, by, budgeted=True)
    return _scaled_down(lines, by, ~in_set("project", [NON_PROJECT_LABEL]))


def _flagged(lines: DataFrame, by: Sequence[str], *levelled: str) -> DataFrame:
    """Project-wide medians, a flag for projects with any number, order of appearance."""
    idle = (F.col("monthbudget") == 0) & (F.col("monthhours") == 0)
    medians = {f"__{c}": F.median(c) for c in levelled}
    lines = attach_group(lines, [*by, "project"], **medians, __busy=F.max(F.col("monthhours") != 0))
    lines = lines.withColumns({c: clamp_zero(f"__{c}") for c in levelled})
    lines = lines.withColumn("keep", F.col("__busy") | ~idle).drop("__busy", *medians)
    ranks = first_appearance_rank(lines, "project", "month", "monthbudget", "level", by)
    return join_null_safe(lines, ranks, [*by, "project"], "left")


def monthly_budget_flat(
    charges: DataFrame,
    projects: DataFrame,
    by: Sequence[str] = (),
    npt: Sequence[str] = NON_PROJECT,
    moved: tuple[str, str] | None = ("2022-02-01", "2022-03-01"),
) -> DataFrame:
    """Budgets scaled to a flat monthly target, against hours per project.

    Each charge counts once per plan row of its project. That product is never
    formed: hours are summed per month and multiplied by the number of plan rows,
    and the median over equally repeated budgets is the median of the budgets.
    """
    plan = share_scaling(projects, "budgeted", FLAT_TARGET, by, "budgeted", ~in_set("project", npt))
    plan = plan.withColumn("budgeted", clamp_zero("budgeted", keep_missing=True))
    plan = stored(plan, "plan")
    per_project = plan.groupBy(*by, "project").agg(F.count(F.lit(1)).alias("__plans"))
    budgets = group_median(plan, [*by, "project"], "budgeted", "monthbudget")
    per_project = join_null_safe(per_project, budgets, [*by, "project"], "left")
    date = remap_month("date", *moved) if moved else F.col("date")
    hours = (
        with_counts(charges)
        .groupBy(*by, "project", month_start(date).alias("month"))
        .agg(sum_lenient("hours").alias("monthhours"))
    )
    lines = stored(join_null_safe(hours, per_project, [*by, "project"], "full"), "months")
    lines = lines.withColumn("monthhours", F.col("monthhours") * F.coalesce("__plans", F.lit(1))).drop("__plans")
    lines = complete(lines, "project", "month", by, {"monthhours": 0.0}).filter(F.col("month").isNotNull())
    return _flagged(lines, by, "monthbudget")


def monthly_target_scale(
    combined: DataFrame,
    by: Sequence[str] = (),
    npt: Sequence[str] = ("Admin", "Leave"),
    moved: tuple[str, str] | None = ("2022-02-01", "2022-03-01"),
) -> DataFrame:
    """Draft rule: project budgets stretched to a target that follows day length."""
    date = remap_month("date", *moved) if moved else F.col("date")
    rows = with_counts(combined).withColumns(
        {"month": month_start(date), "target": F.col("length") * FLAT_TARGET / FLAT_DAY}
    )
    lines = rows.groupBy(*by, "project", "month").agg(
        median_lenient("budgeted", "n").alias("monthbudget"),
        sum_lenient("hours").alias("monthhours"),
        median_lenient("target", "n").alias("monthtarget"),
    )
    lines = stored(lines, "months")
    lines = complete(lines, "project", "month", by, {"monthhours": 0.0}).filter(F.col("month").isNotNull())
    lines = _flagged(lines, by, "monthbudget", "monthtarget")
    nonproj = in_set("project", npt)
    lines = attach_group(lines, [*by, "month"], __sum=F.coalesce(F.sum(F.when(~nonproj, F.col("monthbudget"))), F.lit(0.0)))
    scaled = F.col("monthbudget") * F.try_divide(F.col("monthtarget"), F.col("__sum"))
    return lines.withColumn("monthbudget2", F.when(nonproj, F.col("monthbudget")).otherwise(scaled)).drop("__sum")


# -------------------------------------------------------------- yearly, charts
def yearly_totals(lines: DataFrame, by: Sequence[str] = (), budget: bool = False, profile: bool = False) -> DataFrame:
    """Months, hours and hours per month of each year and project.

    The monthly mean is taken from the already rounded total. With ``budget``
    the same for budgets, with ``profile`` the median profile too.
    """
    sums = [n_distinct("month").alias("months"), round_half_even(F.sum("hours")).alias("hours")]
    if budget:
        sums.append(round_half_even(F.sum("budgeted")).alias("budget"))
    if profile:
        sums.append(F.median("profile").alias("profile"))
    years = lines.groupBy(*by, "year", "project").agg(*sums)
    measured = ["hours", "budget"] if budget else ["hours"]
    years = years.withColumns({f"{c}_month": round_half_even(F.col(c) / F.col("months")) for c in measured})
    return years.filter(sum((F.col(c) for c in measured), F.lit(0.0)) > 0)


def project_months(lines: DataFrame, project: str, by: Sequence[str] = ()) -> DataFrame:
    """Rounded hours per month of one project, empty months left out."""
    months = (
        lines.filter(F.col("project2") == project)
        .groupBy(*by, "year", "project2", "code2", "month")
        .agg(round_half_even(F.sum("hours")).alias("hours"))
    )
    return months.filter(F.col("hours") > 0)


def chart_data(table: DataFrame, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """Long (x, series, value) frame behind a chart.

    ``weekly``: bars of hours and the balance line. ``monthly``: hours per project.
    ``budget``: hours, planned and scaled budgets per project.
    """
    if kind == "weekly":
        long = gather(table, [*by, "period"], ["weekhours", "balance"])
        return long.select(*by, F.col("period").alias("x"), "series", "value")
    measures = {"monthly": ["hours"], "budget": ["hours", "budgeted", "budgeted2"]}
    if kind not in measures:
        raise ValueError("kind must be weekly, monthly or budget")
    long = gather(table, [*by, "month", "project"], measures[kind])
    return long.select(*by, F.col("month").alias("x"), "project", "series", "value")


__all__ = [
    "chart_data",
    "monthly",
    "monthly_budget",
    "monthly_budget_flat",
    "monthly_target_scale",
    "project_months",
    "yearly_totals",
]
