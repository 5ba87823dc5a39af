"""Aggregates with explicit missing-value behaviour.

``strict`` aggregates are missing as soon as one input is missing; ``lenient``
ones skip missing inputs. All of them combine map-side, so a key that holds a
large share of the rows still reaches the shuffle as one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from worktally.functions.scalars import as_col


def sum_strict(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.coalesce(F.sum(c), F.lit(0.0)))


def sum_lenient(c: Column | str) -> Column:
    return F.coalesce(F.sum(as_col(c)), F.lit(0.0))


def sum_where(c: Column | str, cond: Column) -> Column:
    """Lenient sum over the rows that meet a condition."""
    return F.coalesce(F.sum(F.when(cond, as_col(c))), F.lit(0.0))


def median_weighted(c: Column | str, weight: Column | str) -> Column:
    """Exact median of values that each stand for ``weight`` rows.

    Input collapsed to (value, count) gives the same answer as the raw rows. The
    buffer holds each distinct value of a group once: right for day lengths and
    plan figures; ``operators.quantiles.group_median`` takes any column.
    """
    return F.percentile(as_col(c), F.lit(0.5), as_col(weight))


def median_strict(c: Column | str, weight: Column | str | None = None) -> Column:
    c = as_col(c)
    weight = F.lit(1) if weight is None else weight
    return F.when(F.count(c) == F.count(F.lit(1)), median_weighted(c, weight))


def median_lenient(c: Column | str, weight: Column | str | None = None) -> Column:
    return median_weighted(c, F.lit(1) if weight is None else weight)


def mean_lenient(c: Column | str) -> Column:
    return F.avg(as_col(c))


def n_distinct(c: Column | str) -> Column:
    """Distinct values with missing counted as one value."""
    c = as_col(c)
    return F.count_distinct(c) + F.max(F.when(c.isNull(), F.lit(1)).otherwise(F.lit(0)))


def proportion(cond: Column) -> Column:
    """Share of rows meeting a condition; rows where it is missing are left out."""
    return F.avg(cond.cast("double"))
