"""Weekday tables of hours per week, project and code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktally.functions.aggregates import sum_lenient, sum_where
from worktally.functions.scalars import pad_cell, weekday_label, zero_to_null
from worktally.operators.cleaning import numeric_columns
from worktally.operators.joins import attach_group, join_null_safe
from worktally.operators.reshape import WEEKDAYS, row_totals
from worktally.plans.charges import strict_hours, with_counts


def _week_cells(rows: DataFrame, ids: Sequence[str], blank_zero: bool) -> DataFrame:
    """Hours per id and weekday; a day with an entry without hours is missing."""
    day = weekday_label("date")
    cells = []
    for name in WEEKDAYS:
        hours = strict_hours(day == name)
        cells.append((zero_to_null(hours) if blank_zero else hours).alias(name))
    return rows.groupBy(*ids).agg(*cells)


def week_table(
    combined: DataFrame,
    done: str,
    by: Sequence[str] = (),
    ids: Sequence[str] = ("project", "code"),
    hidden: Sequence[str] = (),
    unlisted: Sequence[str] = ("Admin",),
) -> DataFrame:
    """Monday to Sunday hours of the weeks after ``done``.

    ``Total`` sums a line, ``Week`` all lines of the week and ``Sheet`` those of
    projects not in ``unlisted``. Lines without hours are left out, so charges
    alone (without blank weeks) give the same table. ``hidden`` ids take part in
    the grouping but are not shown.
    """
    recent = with_counts(combined).filter(F.col("period") > F.lit(done).cast("date"))
    lines = row_totals(_week_cells(recent, [*by, "period", *ids], blank_zero=True))
    listed = F.coalesce(~F.col("project").isin(list(unlisted)), F.lit(False))
    lines = attach_group(lines, [*by, "period"], Sheet=sum_where("Total", listed), Week=sum_lenient("Total"))
    return lines.filter(F.col("Total") > 0).drop(*hidden)


def week_table_planned(charges: DataFrame, projects: DataFrame, done: str, by: Sequence[str] = ()) -> DataFrame:
    """Weekday table of the charges alone, codes looked up in the plan sheet."""
    recent = with_counts(charges).filter(F.col("period") > F.lit(done).cast("date"))
    keys = [*by, "year", "project", "subproject"]
    plan = projects.select(*keys, "code", "subcode")
    ids = [*by, "year", "period", "project", "subproject", "code", "subcode"]
    lines = row_totals(_week_cells(join_null_safe(recent, plan, keys, "left"), ids, blank_zero=False))
    lines = attach_group(lines, [*by, "year", "period"], Week=sum_lenient("Total"))
    return lines.drop("year", "subproject", "subcode")


def daily(charges: DataFrame, projects: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Hours per date and project with the codes of the plan sheet."""
    keys = ["year", "project", "subproject"]
    days = with_counts(charges).groupBy(*by, "date", "period", *keys).agg(strict_hours().alias("dayhours"))
    coded = join_null_safe(days, projects.select(*by, *keys, "code", "subcode"), [*by, *keys], "left")
    return coded.select(
        *by, "year", "period", "date", "project", "subproject", "code", "subcode", "dayhours", weekday_label("date").alias("wday")
    )


def printable(table: DataFrame) -> DataFrame:
    """Numbers as one-decimal text, missing ones as a dash."""
    return table.withColumns({c: pad_cell(F.col(c).cast("double")) for c in numeric_columns(table)})
