"""Dropping, filling, checking and de-duplicating rows and columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worktally.operators.joins import attach_group, join_null_safe
from worktally.session import stored


# ------------------------------------------------------------- missing values
def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers have one form: NaN becomes null in float columns."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in floats})


def fill_const(df: DataFrame, values: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def fill_with_max(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Missing values take the largest value of the whole column, or of their ``by`` group."""
    if not by:
        return df.withColumn(col, F.coalesce(F.col(col), df.select(F.max(col)).scalar()))
    filled = attach_group(df, by, __max=F.max(col))
    return filled.withColumn(col, F.coalesce(F.col(col), F.col("__max"))).select(*df.columns)


def is_missing(df: DataFrame, col: str) -> Column:
    """Null, or NaN in a column of floating numbers."""
    c = df[f"`{col}`"]
    return c.isNull() | F.isnan(c) if isinstance(df.schema[col].dataType, (T.FloatType, T.DoubleType)) else c.isNull()


def quality_gate(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Split into (rows with every required value, rejected rows); NaN counts as missing."""
    incomplete = F.lit(False)
    for c in required:
        incomplete = incomplete | is_missing(df, c)
    return df.filter(~incomplete), df.filter(incomplete)


def freshness(df: DataFrame, col: str, into: str = "latest") -> DataFrame:
    return df.agg(F.max(col).alias(into))


def apply_to(df: DataFrame, fn: Callable[[Column], Column], cols: Iterable[str] | None = None) -> DataFrame:
    """Apply one expression to the given columns (all numeric ones by default)."""
    return df.withColumns({c: fn(F.col(c)) for c in (numeric_columns(df) if cols is None else cols)})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


# -------------------------------------------------- empty and constant content
def remove_empty(df: DataFrame, which: str | Sequence[str] = ("rows", "cols"), cutoff: float = 1.0) -> DataFrame:
    """Drop rows and columns whose missing share is at least ``cutoff``.

    Rows need a filter only. Columns need one aggregate job that returns a
    single row of counts; with both, columns are judged after the row filter.
    """
    which = (which,) if isinstance(which, str) else which
    if "rows" in which:
        missing = sum((is_missing(df, c).cast("int") for c in df.columns), F.lit(0))
        df = df.filter(missing / F.lit(len(df.columns)) < F.lit(cutoff))
    if "cols" in which:
        total, *present = df.agg(F.count(F.lit(1)), *[F.count(F.when(~is_missing(df, c), 1)) for c in df.columns]).first()
        df = df.select(*[c for c, k in zip(df.columns, present) if total == 0 or (total - k) / total < cutoff])
    return df


def remove_constant(df: DataFrame, na_rm: bool = False) -> DataFrame:
    """Drop columns holding one value only; missing is a value unless ``na_rm``.

    One aggregate pass of min, max and count, no distinct and no shuffle of rows.
    """
    checks = [F.count(F.lit(1))]
    for c in df.columns:
        checks += [F.count(F.col(c)), F.min(c).eqNullSafe(F.max(c))]
    total, *stats = df.agg(*checks).first()
    keep = []
    for c, present, same in zip(df.columns, stats[::2], stats[1::2]):
        constant = same and (na_rm or present in (0, total))
        if not constant:
            keep.append(c)
    return df.select(*keep)


# ------------------------------------------------------------------ duplicates
def get_dupes(df: DataFrame, cols: Sequence[str] | None = None, sort: bool = True, wide: bool = False) -> DataFrame:
    """Every record that shares its key with another, with ``dupe_count``.

    Keys are counted first (map-side combine), so only keys that repeat meet
    the rows again, in a join whose hot keys AQE splits. ``wide`` is for long
    text keys: rows whose 64-bit key hash is unique leave before any text is
    shuffled, then the remaining texts are compared in full.
    """
    cols = list(cols or df.columns)
    rows = df
    if wide:
        hashed = df.withColumn("__hash", F.xxhash64(*cols))
        again = hashed.groupBy("__hash").count().filter("count > 1").select("__hash")
        rows = stored(hashed.join(again, "__hash", "left_semi").drop("__hash"), "repeats")
    repeated = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("dupe_count")).filter("dupe_count > 1")
    out = join_null_safe(rows, repeated, cols, "inner")
    rest = [c for c in df.columns if c not in cols]
    out = out.select(*cols, "dupe_count", *rest)
    if sort:
        # The other columns break ties, which lets the range sort split a hot key.
        out = out.orderBy(F.desc("dupe_count"), *[F.col(c).asc_nulls_last() for c in cols + rest])
    return out


# ------------------------------------------------------------- value relations
def _value_range(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Smallest and largest value and row count per group, by way of value counts."""
    counts = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.min(col).alias("first_value"), F.max(col).alias("other_value"), F.sum("n").alias("n"))


def single_value_report(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Groups in which ``col`` has more than one value, with two witnesses."""
    return _value_range(df, by, col).filter(F.col("first_value") != F.col("other_value"))


def single_value(df: DataFrame, by: Sequence[str], col: str, into: str | None = None, info: str = "") -> DataFrame:
    """Fill the only value of each group into its missing cells.

    The query fails, naming the group, where a group has several values.
    """
    into = into or col
    named = F.concat_ws(", ", *[F.concat(F.lit(f"{k} = "), F.coalesce(F.col(k).cast("string"), F.lit("NA"))) for k in by])
    failure = F.raise_error(F.concat(F.lit(f"{info or col}: more than one value for "), named))
    only = F.when(F.col("first_value") != F.col("other_value"), failure.cast(df.schema[col].dataType)).otherwise(F.col("other_value"))
    values = _value_range(df, by, col).select(*by, only.alias("__only"))
    return join_null_safe(df, values, by, "left").withColumn(into, F.col("__only")).drop("__only")


#: Sketches of 2**14 registers: two estimates of one number differ by more than this share with about seven standard errors.
SKETCH_LOG2, SKETCH_ERROR = 14, 0.08
SKETCHES_AT_ONCE = 500


def _estimates(df: DataFrame, sets: Sequence[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    """About how many distinct rows each set of columns has; missing is a value."""
    found: dict[tuple[str, ...], int] = {}
    for at in range(0, len(sets), SKETCHES_AT_ONCE):
        some = sets[at : at + SKETCHES_AT_ONCE]
        # The hash passes over missing values, so each is told by a flag.
        hashes = [F.xxhash64(*[x for c in names for x in (df[f"`{c}`"], df[f"`{c}`"].isNull())]) for names in some]
        found |= zip(some, df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(h, F.lit(SKETCH_LOG2))) for h in hashes]).first())
    return found


def get_one_to_one(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Clusters of columns in a one-to-one relation, values need not be equal.

    Two columns are one-to-one exactly when each column and the pair have the
    same number of distinct values (missing counts as a value). Sketches, which
    merge and shuffle no values, estimate the columns in one pass and the pairs of
    about equal columns in another; only what they cannot tell apart is counted
    exactly, in a last pass. An estimate rules a pair out when it is off by more
    than ``SKETCH_ERROR``, far beyond what a sketch errs. Each pass returns one row.
    """
    cols = list(cols or df.columns)

    def near(x: int, y: int) -> bool:
        return abs(x - y) <= max(1, SKETCH_ERROR * max(x, y))

    singles = _estimates(df, [(c,) for c in cols])
    pairs = [(a, b) for a, b in combinations(cols, 2) if near(singles[a,], singles[b,])]
    together = _estimates(df, pairs)
    pairs = [(a, b) for a, b in pairs if near(together[a, b], singles[a,]) and near(together[a, b], singles[b,])]
    open_ = [*dict.fromkeys((c,) for pair in pairs for c in pair), *pairs]
    exact = dict(zip(open_, df.agg(*[F.count_distinct(F.struct(*[f"`{c}`" for c in names])) for names in open_]).first())) if open_ else {}
    leader = {c: c for c in cols}
    for a, b in pairs:
        if exact[a, b] == exact[a,] == exact[b,] and leader[b] == b:
            leader[b] = leader[a]
    heads = [c for c in cols if leader[c] == c and c in [leader[o] for o in cols if o != c]]
    found = [(heads.index(leader[c]) + 1, c) for c in cols if leader[c] in heads]
    return df.sparkSession.createDataFrame(found, "cluster bigint, column_name string")
