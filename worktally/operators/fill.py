"""Carrying the last known value forward."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worktally.operators.joins import join_null_safe
from worktally.operators.ranking import carried_over


def carry_forward(df: DataFrame, col: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Fill missing ``col`` with the last known one before it in ``order``, safe for groups of any size.

    The order may be of any type: timestamps, row numbers, text. Each range of the whole
    order knows the last value it holds; a range starts from the latest one of the
    ranges before it, a small table with one row for each group and range. Missing
    order keys come last; among rows that tie in every key, known values come first
    and the larger ones before, so that the result does not depend on the plan.
    """
    return carried_over(df, col, by, order)


def fill_down(df: DataFrame, col: str, by: Sequence[str], date: str = "date") -> DataFrame:
    """Fill missing ``col`` with the last known one of its group.

    Rows of a group are taken in order of ``date`` and, within a date, of
    ``col`` with missing last, so the value to carry is the largest one of the
    latest date that has any. It is found on a summary of one row per group and
    date: that window holds at most as many rows as the calendar has days, no
    matter how many records a hot group has. The records that miss a value are
    joined to the summary and are never sorted. Where ``date`` is no date, days do not
    bound the summary, and ``carry_forward`` does the same on (``date``, ``col``).
    """
    if not isinstance(df.schema[date].dataType, T.DateType):
        return carry_forward(df, col, by, [date])
    keys = [*by, date]
    in_order = (
        Window.partitionBy(*by)
        .orderBy(F.col(date).asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # Distinct values are hashed map-side; a maximum of text would sort all rows.
    carried = (
        df.select(*keys, col)
        .distinct()
        .groupBy(*keys)
        .agg(F.max(col).alias("__known"), F.max(F.col(col).isNull()).alias("__gap"))
        .withColumn("__known", F.last("__known", ignorenulls=True).over(in_order))
        .filter(F.col("__gap") & F.col("__known").isNotNull())
        .drop("__gap")
    )
    # Records that already have a value pass through and are not shuffled.
    filled = join_null_safe(df.filter(F.col(col).isNull()), carried, keys, "left").withColumn(col, F.col("__known"))
    return df.filter(F.col(col).isNotNull()).union(filled.select(*df.columns))
