"""Equi joins whose keys match missing with missing, and joins built on them.

No join here carries a broadcast hint. Spark compares the measured size of each
side with ``spark.sql.autoBroadcastJoinThreshold`` (again at run time under
AQE), so a side is only broadcast while it is small and a hot key in a shuffled
join is split by the AQE skew rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worktally.session import stored

# Blocks of a binned range join: this many of one level make one of the next.
BLOCK = 8
LEVELS = 6
# Keys of at most so many pairs of a row and a range take blocks from this level on (512 days).
# Testing a pair costs about a thousandth of sorting and sending the small blocks of a range.
PAIRS = 1_000_000
COARSE = 3
BLOCKS = "array<struct<level:int,number:bigint>>"


def join_null_safe(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    condition: Column | None = None,
) -> DataFrame:
    """Join on equal key columns, a missing key matching a missing key.

    The key columns appear once. ``condition`` may name columns of both sides
    (non-key column names must differ). Non-nullable keys turn into plain
    equality, and ``<=>`` is still hashed by Spark, so this is a hash or merge
    join like any other.
    """
    hidden = {k: f"__r_{k}" for k in on}
    right = right.withColumnsRenamed(hidden)
    keys = [F.col(k).eqNullSafe(F.col(h)) for k, h in hidden.items()]
    if condition is not None:
        keys.append(condition)
    joined = left.join(right, reduce(lambda a, b: a & b, keys), how)
    if how in ("left_semi", "left_anti", "semi", "anti"):
        return joined
    if how in ("full", "outer", "full_outer", "fullouter"):
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(h)) for k, h in hidden.items()})
    elif how in ("right", "right_outer", "rightouter"):
        joined = joined.withColumns({k: F.col(h) for k, h in hidden.items()})
    return joined.drop(*hidden.values())


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every column name the two sides share."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("no common column")
    return join_null_safe(left, right, shared, "left")


def validity_join(
    left: DataFrame,
    ranges: DataFrame,
    on: Sequence[str],
    date: str = "date",
    start: str = "startdate",
    end: str = "enddate",
) -> DataFrame:
    """Rows of ``left`` with each range of equal key that contains their date."""
    inside = (F.col(date) >= F.col(start)) & (F.col(date) <= F.col(end))
    return join_null_safe(left, ranges, on, "inner", inside)


def _blocks(start: Column, end: Column, finest: int = 0) -> Column:
    """Aligned blocks (level, number) of ``BLOCK ** level`` days that fill a range of day numbers, each day once.

    On every level the ragged ends up to the next whole block are spelled out and the middle
    goes on one level up: at most ``2 * (BLOCK - 1)`` blocks for each level but the last. With
    a ``finest`` level, ends inside a block of that level count as the whole block.
    """
    none = F.array().cast(BLOCKS)

    def spelled(level: Column, first: Column, last: Column) -> Column:
        named = F.transform(F.sequence(first, last), lambda n: F.struct(level.alias("level"), n.alias("number")))
        return F.when(first <= last, named).otherwise(none)

    def step(state: Column, level: Column) -> Column:
        a, b, done = state["a"], state["b"], state["blocks"]
        up, down = F.ceil(a / BLOCK).cast("long"), F.floor((b + 1) / BLOCK).cast("long") - 1
        goes_on = state["open"] & (up <= down) & (level < LEVELS - 1)
        ends = F.concat(done, spelled(level, a, up * BLOCK - 1), spelled(level, (down + 1) * BLOCK, b))
        blocks = F.when(goes_on, ends).when(state["open"], F.concat(done, spelled(level, a, b))).otherwise(done)
        middle = F.when(goes_on, up).otherwise(a), F.when(goes_on, down).otherwise(b)
        return F.struct(middle[0].alias("a"), middle[1].alias("b"), goes_on.alias("open"), blocks.alias("blocks"))

    a, b = _block_of(start, finest), _block_of(end, finest)
    begin = F.struct(a.alias("a"), b.alias("b"), F.lit(True).alias("open"), none.alias("blocks"))
    return F.aggregate(F.array(*[F.lit(n) for n in range(finest, LEVELS)]), begin, step, lambda state: state["blocks"])


def _block_of(day: Column, level: int) -> Column:
    return F.floor(day / F.lit(BLOCK**level)).cast("long")


def _crowded(left: DataFrame, ranges: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys whose rows and ranges make more than ``PAIRS`` pairs, or that have as many of either."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = left.select(*on, one.alias("__rows"), none.alias("__ranges")).union(
        ranges.select(*on, none.alias("__rows"), one.alias("__ranges"))
    )
    counts = both.groupBy(*on).agg(F.sum("__rows").alias("__rows"), F.sum("__ranges").alias("__ranges"))
    pairs = F.greatest("__rows", F.lit(1)).cast("double") * F.greatest("__ranges", F.lit(1))
    return counts.filter(pairs > PAIRS).select(*on)


def _binned(left: DataFrame, ranges: DataFrame, on: Sequence[str], date: str, start: str, end: str, finest: int) -> DataFrame:
    """Join on key and block, of blocks from level ``finest`` on; only blocks of one day need no test of the ends."""
    number = lambda c: F.unix_date(c).cast("long")
    # One whole number names a block: its own number and its level as last digit.
    named = F.transform(_blocks(number(start), number(end), finest), lambda b: b["number"] * LEVELS + b["level"])
    spread = ranges.withColumn("__block", F.explode(named))
    levels = sorted(r[0] for r in spread.select(F.pmod("__block", F.lit(LEVELS))).distinct().collect())
    own = F.array(*[_block_of(number(date), n) * LEVELS + n for n in levels]).cast("array<bigint>")
    looked = left.withColumn("__block", F.explode(own))
    inside = (F.col(date) >= F.col(start)) & (F.col(date) <= F.col(end)) if finest else None
    return join_null_safe(looked, spread, [*on, "__block"], "inner", inside).drop("__block")


def binned_validity_join(
    left: DataFrame,
    ranges: DataFrame,
    on: Sequence[str],
    date: str = "date",
    start: str = "startdate",
    end: str = "enddate",
) -> DataFrame:
    """``validity_join`` for keys with many ranges, or for no key at all (``on=[]``).

    A range is cut into aligned blocks of 1, 8, 64, 512, 4,096 and 32,768 days; a row looks
    up the block of its date on each level that occurs. The join is on equal key and
    block, a date lies in one block of a range only, so the pairs formed are the pairs
    returned, and the rows of a hot key are spread over its blocks.

    Keys with at most ``PAIRS`` pairs of a row and a range are cut into blocks of
    ``BLOCK ** COARSE`` days and larger, so that a range becomes few rows; there the
    ends are tested, at most ``PAIRS`` times for a key. The driver sees the levels.
    Ranges without a start or end, or that end before they start, contain no date. All
    three columns must be dates.
    """
    for df, c in ((left, date), (ranges, start), (ranges, end)):
        if not isinstance(df.schema[c].dataType, T.DateType):
            raise TypeError(f"{c} must be a date column")
    left, ranges = left.filter(F.col(date).isNotNull()), ranges.filter(F.col(start) <= F.col(end))
    if not on:
        return _binned(left, ranges, on, date, start, end, 0)
    crowded = stored(_crowded(left, ranges, on), "crowded")
    if crowded.isEmpty():
        return _binned(left, ranges, on, date, start, end, COARSE)
    few, many = ([join_null_safe(df, crowded, on, how) for df in (left, ranges)] for how in ("left_anti", "left_semi"))
    return _binned(*few, on, date, start, end, COARSE).union(_binned(*many, on, date, start, end, 0))


def attach_group(df: DataFrame, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """Add per-group aggregates to every row.

    Aggregate plus join back instead of an unordered window: the aggregate
    combines map-side and a hot group is never gathered in one task.
    """
    if not by:
        totals = df.agg(*[expr.alias(name) for name, expr in aggregates.items()])
        return df.withColumns({name: totals.select(name).scalar() for name in aggregates})
    totals = df.groupBy(*by).agg(*[expr.alias(name) for name, expr in aggregates.items()])
    return join_null_safe(df, totals, by, "left")


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """All rows of all feeds, columns matched by name, absent columns missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)
