"""Running totals, row numbers, shares and order of first appearance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worktally.operators.joins import attach_group, join_null_safe
from worktally.session import stored


def running(by: Sequence[str], order: Column):
    """Window from the start of a group to the current row."""
    return (
        Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def cumsum_strict(c: str, window) -> Column:
    """Running total, missing from the first missing value on."""
    return F.when(F.count(F.col(c)).over(window) == F.count(F.lit(1)).over(window), F.sum(c).over(window))


def numbered(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    into: str = "seq",
    steps: Sequence[str] = (),
) -> DataFrame:
    """Row number inside each group, safe for groups of any size.

    Rows are dealt by ranges of the whole order (group, ``steps``, ``order``),
    whose edges Spark samples: an outlier, a hot group or a hot leading value is
    shared by many tasks, and only rows that tie in every key stay together.
    They are sorted inside their range and stored once, so that both later
    readers see the same ranges. There a group is one run of row ids; it starts
    after the rows that the group has in earlier ranges. Missing order keys sort
    last.
    """
    placed = _placed(df, by, [*steps, *order])
    runs = placed.groupBy(*by, "__piece").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(_earlier(by)), F.lit(0))
    shifts = runs.select(*by, "__piece", (before - F.col("__first") + 1).alias("__shift"))
    out = join_null_safe(placed, shifts, [*by, "__piece"], "left")
    return out.withColumn(into, F.col("__id") + F.col("__shift")).drop("__id", "__piece", "__shift")


def _placed(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows in ranges of the whole order, stored, with ``__id`` (rising along the order) and ``__piece`` (the range)."""
    keys = [*[F.col(c) for c in by], *[F.col(c).asc_nulls_last() for c in order]]
    # Upper bits: range; lower 33 bits: place in it.
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    return stored(ordered, "numbered").withColumn("__piece", F.shiftright("__id", 33))


def _earlier(by: Sequence[str]):
    return Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, into: str) -> DataFrame:
    """Sum of ``value`` over the rows of the group up to and with each row, safe for groups of any size.

    Each range of the whole order adds up its own rows and starts from the sums of the ranges before it, a small table
    with one row for each group and range. Rows that tie in every order key are added in any order.
    """
    placed = _placed(df, by, order)
    sums = placed.groupBy(*by, "__piece").agg(F.sum(value).alias("__held"))
    starts = sums.select(*by, "__piece", F.coalesce(F.sum("__held").over(_earlier(by)), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*by, "__piece").orderBy("__id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = join_null_safe(placed.withColumn("__part", F.sum(value).over(inside)), starts, [*by, "__piece"], "left")
    return out.withColumn(into, F.col("__start") + F.coalesce("__part", F.lit(0))).drop("__id", "__piece", "__start", "__part")


def carried_over(df: DataFrame, col: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last known ``col`` up to each row of its group; see ``fill.carry_forward``."""
    placed = _placed(df, by, list(dict.fromkeys([*order, col])))
    ends = placed.groupBy(*by, "__piece").agg(F.max_by(col, F.when(F.col(col).isNotNull(), F.col("__id"))).alias("__end"))
    starts = ends.select(*by, "__piece", F.last("__end", ignorenulls=True).over(_earlier(by)).alias("__start"))
    inside = Window.partitionBy(*by, "__piece").orderBy("__id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.withColumn("__last", F.last(col, ignorenulls=True).over(inside))
    out = join_null_safe(out, starts, [*by, "__piece"], "left")
    return out.withColumn(col, F.coalesce("__last", "__start")).select(*df.columns)


def first_appearance_rank(
    df: DataFrame, item: str, axis: str, weight: str, into: str = "rank", by: Sequence[str] = ()
) -> DataFrame:
    """Rank items by where they first show up in (axis, weight descending) order.

    One row per item is ranked, not the data. Missing weights come last.
    """
    place = F.struct(F.col(axis).alias("at"), F.col(weight).isNull().alias("none"), (-F.col(weight).cast("double")).alias("down"))
    firsts = df.groupBy(*by, item).agg(F.min(place).alias("__first")).select(*by, item, "__first.*")
    return numbered(firsts, by, ["down", item], into, steps=["at", "none"]).select(*by, item, into)


def share_scaling(df: DataFrame, value: str, target: Column | float, by: Sequence[str], into: str, cond: Column | None = None) -> DataFrame:
    """value * target / group total; missing where the total is zero.

    ``cond`` limits the rows that count towards the total.
    """
    target = target if isinstance(target, Column) else F.lit(float(target))
    counted = F.col(value) if cond is None else F.when(cond, F.col(value))
    out = attach_group(df, by, __total=F.coalesce(F.sum(counted), F.lit(0.0)))
    return out.withColumn(into, F.try_divide(F.col(value) * target, F.col("__total"))).drop("__total")
