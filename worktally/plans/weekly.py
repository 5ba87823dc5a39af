"""Weekly hours, targets and running balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worktally.functions.aggregates import median_strict
from worktally.operators.ranking import cumsum_strict, running
from worktally.plans.charges import strict_hours, with_counts

# Contract hours per week and working days per week.
WEEK_HOURS = 36.0
WEEK_DAYS = 5.0

TARGETS = ("constant", "current", "cumulative", "lagged")


def weekly_balance(charges: DataFrame, target: str = "cumulative", by: Sequence[str] = ()) -> DataFrame:
    """Hours per week and how far they run ahead of the target.

    ``constant``: a fixed target for every earlier week. ``current``: this
    week's target for every earlier week. ``cumulative``: all targets so far,
    the open last week has no balance. ``lagged``: targets of earlier weeks only.

    Data is reduced to one row per week before the running totals, so the
    ordered window holds as many rows as the calendar has weeks.
    """
    if target not in TARGETS:
        raise ValueError(f"target must be one of {TARGETS}, not {target!r}")
    weeks = (
        with_counts(charges)
        .groupBy(*by, "period")
        .agg(strict_hours().alias("weekhours"), (median_strict("length", "n") * WEEK_DAYS).alias("weektarget"))
    )
    order = F.col("period").asc_nulls_last()
    upto = running(by, order)
    ordered = Window.partitionBy(*by).orderBy(order)
    earlier_weeks = F.row_number().over(ordered) - 1
    weeks = weeks.withColumn("cumhours", cumsum_strict("weekhours", upto))
    if target == "constant":
        return weeks.drop("weektarget").withColumn("balance", F.col("cumhours") - earlier_weeks * WEEK_HOURS)
    if target == "current":
        return weeks.withColumn("balance", F.col("cumhours") - earlier_weeks * F.col("weektarget"))
    if target == "lagged":
        weeks = weeks.withColumn("__due", F.lag("weektarget", 1, 0.0).over(ordered))
        weeks = weeks.withColumn("cumtarget", cumsum_strict("__due", upto)).drop("__due")
        return weeks.withColumn("balance", F.col("cumhours") - F.col("cumtarget"))
    weeks = weeks.withColumn("cumtarget", cumsum_strict("weektarget", upto))
    is_open = F.lead(F.lit(1)).over(ordered).isNull()
    return weeks.withColumn("balance", F.when(~is_open, F.col("cumhours") - F.col("cumtarget")))
