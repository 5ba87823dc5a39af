"""Independence tests on counted tables."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktally.operators.tabulate import COL, ROW, Tabulation, tabyl

# Fixed value: two table probabilities this close count as equally likely.
TIE_TOLERANCE = 1e-7


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * scale
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = h = 1 / b
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def chisq_stat(table: Tabulation, correct: bool = True) -> DataFrame:
    """One row: statistic, degrees of freedom, number of observations.

    Totals do not count. Uses sum(n^2 / (row * col)), to which absent cells
    contribute nothing, so the full grid is never built. A 2x2 table gets the
    continuity correction unless switched off.
    """
    if table.totals:
        warnings.warn("totals do not take part in the test", stacklevel=2)
    counts = table.held.filter(~F.col("row_total") & ~F.col("col_total") & (F.col("n") > 0)).select(F.col(ROW).alias("a"), F.col(COL).alias("b"), "n")
    # Missing is a category like any other; as a field of a struct it joins itself.
    counts = counts.groupBy(F.struct("a").alias("a"), F.struct("b").alias("b")).agg(F.sum("n").alias("n"))
    rows = counts.groupBy("a").agg(F.sum("n").alias("r"))
    cols = counts.groupBy("b").agg(F.sum("n").alias("c"))
    cells = counts.join(rows, "a").join(cols, "b")
    total = F.sum("n").cast("double")
    sums = cells.agg(
        total.alias("n"),
        F.sum(F.col("n") * F.col("n") / (F.col("r").cast("double") * F.col("c"))).alias("q"),
        # Every cell of a 2x2 table is equally far from its expectation.
        F.max(F.abs(F.col("n") - F.col("r").cast("double") * F.col("c") / counts.agg(F.sum("n").alias("t")).scalar())).alias("gap"),
    )
    sums = sums.withColumns(
        {
            "r": rows.agg(F.count(F.lit(1)).alias("k")).scalar(),
            "c": cols.agg(F.count(F.lit(1)).alias("k")).scalar(),
        }
    )
    plain = F.col("n") * (F.col("q") - 1)
    shrunk = plain * F.pow(1 - F.least(F.lit(0.5), F.col("gap")) / F.col("gap"), F.lit(2.0))
    two_by_two = (F.col("r") == 2) & (F.col("c") == 2) & F.lit(correct) & (F.col("gap") > 0)
    return sums.select(
        F.when(two_by_two, shrunk).otherwise(plain).alias("statistic"),
        ((F.col("r") - 1) * (F.col("c") - 1)).cast("bigint").alias("dof"),
        F.col("n").cast("bigint").alias("n"),
    )


def chisq_test(df: DataFrame, a: str, b: str, correct: bool = True) -> DataFrame:
    """Independence test of two columns: statistic, dof, n and p-value."""

    @F.pandas_udf("double")
    def tail(statistic: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([_upper_gamma(k / 2, max(x, 0.0) / 2) if k > 0 else math.nan for x, k in zip(statistic, dof)])

    return chisq_stat(tabyl(df, a, b), correct).withColumn("p_value", tail("statistic", "dof"))


def _tail_sum(log_start: float, ratios) -> float:
    """Sum of a falling sequence given its first log term and next/this ratios."""
    total, term = 1.0, 1.0
    for ratio in ratios:
        terms = term * np.cumprod(ratio)
        total += float(terms.sum())
        term = float(terms[-1])
        if term < total * 1e-18:
            break
    return math.exp(log_start) * total


def _fisher_two_sided(a: int, b: int, c: int, d: int, chunk: int = 4096) -> float:
    """Two-sided exact p-value of one 2x2 table.

    The table probability rises to one peak and falls, so the tables no likelier
    than the observed one are two tails. The edge on the far side is found by
    bisection and each tail is summed until its terms vanish.
    """
    row, col, total = a + b, a + c, a + b + c + d
    lo, hi = max(0, row + col - total), min(row, col)
    base = (
        math.lgamma(row + 1) + math.lgamma(total - row + 1) + math.lgamma(col + 1)
        + math.lgamma(total - col + 1) - math.lgamma(total + 1)
    )

    def log_p(k: int) -> float:
        return base - (
            math.lgamma(k + 1) + math.lgamma(row - k + 1) + math.lgamma(col - k + 1) + math.lgamma(total - row - col + k + 1)
        )

    limit = log_p(a) + math.log1p(TIE_TOLERANCE)
    peak = (row + 1) * (col + 1) // (total + 2)
    if log_p(peak) <= limit:
        return 1.0

    def edge(outer: int, inner: int) -> int | None:
        """Value closest to the peak that is still no likelier than observed."""
        if log_p(outer) > limit:
            return None
        while abs(inner - outer) > 1:
            middle = (inner + outer) // 2
            outer, inner = (middle, inner) if log_p(middle) <= limit else (outer, middle)
        return outer

    p = 0.0
    left, right = edge(lo, peak), edge(hi, peak)
    if left is not None:
        def falling():
            for top in range(left, lo, -chunk):
                k = np.arange(top, max(lo, top - chunk), -1, dtype="float64")
                yield k * (total - row - col + k) / ((row - k + 1) * (col - k + 1))
        p += _tail_sum(log_p(left), falling())
    if right is not None:
        def rising():
            for low in range(right, hi, chunk):
                k = np.arange(low, min(hi, low + chunk), dtype="float64")
                yield (row - k) * (col - k) / ((k + 1) * (total - row - col + k + 1))
        p += _tail_sum(log_p(right), rising())
    return min(p, 1.0)


def fisher_test_2x2(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Exact test of a 2x2 table per group; ``a`` and ``b`` hold 0/1 or booleans.

    Spark counts the four cells of every group; Python sees one row per group.
    """
    hit_a, hit_b = F.col(a).cast("boolean"), F.col(b).cast("boolean")
    cells = {
        "n11": F.count_if(hit_a & hit_b),
        "n10": F.count_if(hit_a & ~hit_b),
        "n01": F.count_if(~hit_a & hit_b),
        "n00": F.count_if(~hit_a & ~hit_b),
    }
    counted = df.groupBy(*by).agg(*[v.alias(k) for k, v in cells.items()])

    @F.pandas_udf("double")
    def p_value(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for columns in parts:
            yield pd.Series([_fisher_two_sided(*map(int, row)) for row in zip(*columns)], dtype="float64")

    return counted.withColumn("p_value", p_value(*cells))
