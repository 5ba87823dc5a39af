"""Exact quantiles of a large column and binning by them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worktally.operators.joins import join_null_safe
from worktally.session import stored

# Parts that one round of narrowing cuts an interval into, and the accuracy of the cuts.
CUTS = 64
CUT_ACCURACY = 2_000
# Distinct values of one group that the ordered pass at the end may see.
SORT_LIMIT = 1_000_000


def group_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact quantiles of each group, a column for each name in ``probs``, for groups of any size and any values.

    Quantiles lie between neighbouring values by linear interpolation. Values are counted
    first, so ties never pile up. All groups and probabilities keep their own interval in one
    small table. As long as one holds more than ``SORT_LIMIT`` distinct values, a round cuts
    every such interval by approximate percentiles, counts the parts exactly and goes on with
    the part that holds the wanted rank; how good the cuts are decides about speed only.
    What is left of an interval is ordered in one task. The number of jobs depends on the
    largest group, not on how many groups or probabilities there are. Missing and NaN do not
    count; groups without values have no row.
    """
    keys = [*by, "__all"]
    x, lo = F.col("__x"), "__lo"
    present = df.select(*by, F.lit(0).alias("__all"), F.col(value).cast("double").alias("__x")).filter(x.isNotNull() & ~F.isnan(x))
    counts = stored(present.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__n")), "counts")
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"), F.count(F.lit(1)).alias("__held"))
    places = [(F.col("__total") - 1) * F.lit(float(p)) for p in probs.values()]
    ranks = F.array_distinct(F.array(*[end(place) for place in places for end in (F.floor, F.ceil)]))
    whole = [F.lit(0).cast("long").alias("__below"), F.lit(float("-inf")).alias(lo), F.lit(float("inf")).alias("__hi")]
    targets = totals.select(*keys, F.explode(ranks).alias("__rank"), "__held", *whole)
    if (totals.agg(F.max("__held")).first()[0] or 0) > SORT_LIMIT:
        targets = _narrowed(counts, targets, keys)
    # Intervals of a group share no value, so a value meets one of them at most.
    ordered = Window.partitionBy(*keys, lo).orderBy("__x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = _inside(counts, targets, keys).withColumn("__upto", F.col("__below") + F.sum("__n").over(ordered))
    at_rank = (F.col("__rank") < F.col("__upto")) & (F.col("__rank") >= F.col("__upto") - F.col("__n"))
    wanted = targets.select(*keys, lo, "__rank")
    found = join_null_safe(wanted, placed.select(*keys, lo, "__x", "__n", "__upto"), [*keys, lo], "inner", at_rank)
    values = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__x"))).alias("__values"))
    out = join_null_safe(totals, values, keys)

    def between(place: Column) -> Column:
        lower, upper = (F.element_at("__values", end(place)) for end in (F.floor, F.ceil))
        return F.when(lower == upper, lower).otherwise(lower + (place - F.floor(place)) * (upper - lower))

    return out.select(*by, *[between(place).alias(name) for name, place in zip(probs, places)])


def _inside(counts: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counted values with the interval of their group that holds them, values outside of all left out."""
    intervals = targets.select(*keys, "__lo", "__hi", "__below").distinct()
    return join_null_safe(counts, intervals, keys, "inner", F.col("__x").between(F.col("__lo"), F.col("__hi")))


def _narrowed(counts: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The targets with intervals of at most ``SORT_LIMIT`` distinct values."""
    state = ["__rank", "__held", "__below", "__lo", "__hi"]
    targets = stored(targets.select(*keys, *state), "intervals")
    steps = [i / CUTS for i in range(1, CUTS)]
    while targets.agg(F.max("__held")).first()[0] > SORT_LIMIT:
        wide = targets.filter(F.col("__held") > SORT_LIMIT)
        inside = _inside(counts, wide, keys).drop("__below", "__hi")
        cuts = inside.groupBy(*keys, "__lo").agg(F.percentile_approx("__x", steps, CUT_ACCURACY).alias("__cuts"))
        part = F.size(F.filter("__cuts", lambda c: c < F.col("__x"))).alias("__part")
        parts = join_null_safe(inside, cuts, [*keys, "__lo"]).groupBy(*keys, "__lo", part).agg(
            F.sum("__n").alias("__rows"),
            F.count(F.lit(1)).alias("__fewer"),
            F.min("__x").alias("__from"),
            F.max("__x").alias("__to"),
        )
        upto = Window.partitionBy(*keys, "__lo").orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        parts = parts.withColumn("__last", F.sum("__rows").over(upto))
        rank = F.col("__rank") - F.col("__below")
        holds = (rank < F.col("__last")) & (rank >= F.col("__last") - F.col("__rows"))
        found = join_null_safe(wide, parts, [*keys, "__lo"], "inner", holds).select(
            *keys,
            "__rank",
            F.col("__fewer").alias("__held"),
            (F.col("__below") + F.col("__last") - F.col("__rows")).alias("__below"),
            F.col("__from").alias("__lo"),
            F.col("__to").alias("__hi"),
        )
        targets = stored(targets.filter(F.col("__held") <= SORT_LIMIT).unionByName(found), "intervals")
    return targets


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> list[float]:
    """Quantiles of a column with linear interpolation between neighbouring values."""
    names = {f"q{i}": p for i, p in enumerate(probs)}
    found = group_quantiles(df, [], col, names).first()
    if found is None:
        raise ValueError(f"{col} has no values")
    return list(found)


def group_median(df: DataFrame, by: Sequence[str], value: str, into: str = "median") -> DataFrame:
    """Exact median of each group; groups without values have no row."""
    return group_quantiles(df, by, value, {into: 0.5})


def bin_label(lower: float, upper: float, digits: int = 3) -> str:
    return f"({lower:.{digits}g},{upper:.{digits}g}]"


def quantile_bins(
    df: DataFrame, col: str, probs: Sequence[float], into: str = "bin", labels: Sequence[str] | None = None
) -> DataFrame:
    """Label each value with the interval between two of the column's quantiles.

    Intervals exclude their lower edge, so the minimum has no bin.
    """
    edges = exact_quantiles(df, col, probs)
    labels = labels or [bin_label(a, b, 6) for a, b in zip(edges, edges[1:])]
    chosen: Column = F.lit(None).cast("string")
    for lower, upper, label in reversed(list(zip(edges, edges[1:], labels))):
        chosen = F.when((F.col(col) > lower) & (F.col(col) <= upper), F.lit(label)).otherwise(chosen)
    return df.withColumn(into, chosen)
