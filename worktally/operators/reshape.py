"""Wide and long forms, completion of gaps, row totals."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktally.functions.scalars import weekday_label
from worktally.operators.joins import join_null_safe
from worktally.operators.ranking import numbered
from worktally.session import stored

# Column labels of a week, Monday first.
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

# Pieces that an axis is dealt to.
AXIS_PIECES = 1_024


def pivot_week(
    df: DataFrame,
    ids: Sequence[str],
    date: str = "date",
    value: str = "hours",
    cell: Callable[[Column], Column] = F.sum,
) -> DataFrame:
    """One column per weekday, always Monday to Sunday, absent cells missing.

    ``cell`` aggregates the values of one weekday. Seven conditional aggregates
    need one shuffle by ``ids``; ``pivot()`` would shuffle by id and weekday first.
    """
    day = weekday_label(date)
    cells = [cell(F.when(day == name, F.col(value))).alias(name) for name in WEEKDAYS]
    return df.groupBy(*ids).agg(*cells)


def row_totals(df: DataFrame, cols: Sequence[str] = WEEKDAYS, into: str = "Total") -> DataFrame:
    """Sum across those of the columns that exist, missing cells skipped."""
    present = [F.coalesce(F.col(c), F.lit(0.0)) for c in cols if c in df.columns]
    return df.withColumn(into, sum(present, F.lit(0.0)))


def spread(df: DataFrame, ids: Sequence[str], names: str, levels: Sequence, value: Column) -> DataFrame:
    """Aggregate per id and level, levels as columns."""
    return df.groupBy(*ids).pivot(names, list(levels)).agg(value)


def gather(df: DataFrame, ids: Sequence[str], values: Sequence[str], names_to: str = "series", values_to: str = "value") -> DataFrame:
    """Columns back to (name, value) rows."""
    return df.unpivot(list(ids), list(values), names_to, values_to)


def complete(
    df: DataFrame,
    key: str,
    axis: str,
    by: Sequence[str] = (),
    fill: dict | None = None,
) -> DataFrame:
    """Add a row for every absent combination of ``key`` and ``axis`` values.

    The values of ``axis`` are dealt to ``AXIS_PIECES`` pieces by their hash, one
    array for each. A key gets the numbers of the pieces that occur in its ``by``
    group, and an equi join on the number brings the arrays, so that nothing but
    the required combinations is ever produced, no array holds a whole axis, and
    the plan is the same at every size. ``fill`` replaces missing values, those
    that were there before included.
    """
    by = list(by)
    piece = F.pmod(F.xxhash64(axis), F.lit(AXIS_PIECES)).cast("int").alias("__piece")
    # Distinct first, so that the gathered lists merge short partial lists only.
    axes, keys = df.select(*by, axis, piece).distinct(), df.select(*by, key).distinct()
    lists = axes.groupBy(*by, "__piece").agg(F.sort_array(F.collect_list(F.struct(axis))).alias("__axis"))
    numbers = F.collect_set("__piece").alias("__pieces")
    if by:
        dealt = join_null_safe(keys, axes.groupBy(*by).agg(numbers), by)
    else:
        dealt = keys.withColumn("__pieces", axes.agg(numbers).scalar())
    dealt = dealt.withColumn("__piece", F.explode("__pieces")).drop("__pieces")
    grid = join_null_safe(dealt, lists, [*by, "__piece"])
    grid = grid.withColumn("__axis", F.explode("__axis")).select(*by, key, F.col(f"__axis.{axis}").alias(axis))
    out = join_null_safe(grid, df, [*by, key, axis], "left").select(*df.columns)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (fill or {}).items()})


def complete_keys(df: DataFrame, keys: Sequence[str], fill: dict | None = None) -> DataFrame:
    """Add a row for every absent combination of the values of two or more key columns.

    The values of each key are numbered; a combination is one whole number with a digit for
    each key. The numbers that do not occur are taken from a range that Spark generates in
    parts, and their digits joined back to values, so that no product is nested and any axis
    may be large. Rows of ``df`` pass through as they are; only its distinct combinations are
    compared. Missing is a value of its key. ``fill`` replaces missing values of other
    columns, those that were there before included. The driver sees the size of each axis;
    more than 2**63 - 1 combinations are an error.
    """
    keys, spark = list(keys), df.sparkSession
    present = stored(df.select(*keys).distinct(), "present")
    axes = [stored(numbered(present.select(k).distinct(), [], [k], f"__at{i}"), "axis") for i, k in enumerate(keys)]
    sizes = [axis.count() for axis in axes]
    strides = [prod(sizes[i + 1 :]) for i in range(len(keys))]
    if prod(sizes) >= 2**63:
        raise ValueError(f"{prod(sizes)} combinations of {keys}")
    coded = present
    for k, axis in zip(keys, axes):
        coded = join_null_safe(coded, axis, [k])
    code = sum(((F.col(f"__at{i}") - 1) * F.lit(stride) for i, stride in enumerate(strides)), F.lit(0))
    absent = spark.range(prod(sizes)).join(coded.select(code.cast("long").alias("id")), "id", "left_anti")
    digits = [F.expr(f"id div {stride} % {size} + 1") for stride, size in zip(strides, sizes)] if prod(sizes) else [F.lit(0)] * len(keys)
    grid = absent.select(*[digit.alias(f"__at{i}") for i, digit in enumerate(digits)])
    for i, axis in enumerate(axes):
        grid = grid.join(axis, f"__at{i}")
    rest = {f.name: F.lit(None).cast(f.dataType) for f in df.schema.fields if f.name not in keys}
    out = df.unionByName(grid.select(*[rest.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns]))
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (fill or {}).items()})
