"""Feeds in and out: files and tables, buried headers, snapshots."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worktally.functions.names import clean_name_list, clean_names, unique_names
from worktally.operators.joins import join_null_safe

FIND_HEADER = "find_header"


def read_lines(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Delimited text files as (feed, pos, cells) rows.

    ``feed`` is the file, ``pos`` the line number in it, ``cells`` the fields with
    empty ones missing. Files are read in splits as usual: lines are numbered
    inside their split, and a split starts after the line counts of the earlier
    splits of its file, so no file passes through a single task. Quoted fields
    may hold separators but no line breaks.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("feed"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__seq"),
        "value",
    )
    counts = lines.groupBy("feed", "__block").agg(F.min("__seq").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    earlier = Window.partitionBy("feed").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__rows").over(earlier), F.lit(0))).drop("__rows")
    placed = lines.join(starts, ["feed", "__block"])
    outside_quotes = f'{sep if sep.isalnum() else chr(92) + sep}(?=(?:[^"]*"[^"]*")*[^"]*$)'
    fields = F.transform(F.split("value", outside_quotes), _field)
    return placed.select("feed", (F.col("__seq") - F.col("__first") + F.col("__start") + 1).alias("pos"), fields.alias("cells"))


def _field(text: Column) -> Column:
    text = F.trim(text)
    quoted = F.regexp_extract(text, '^"(.*)"$', 1)
    text = F.when(text.rlike('^".*"$'), F.replace(quoted, F.lit('""'), F.lit('"'))).otherwise(text)
    return F.nullif(text, F.lit(""))


def find_header(lines: DataFrame, value: str | None = None, column: int = 1) -> DataFrame:
    """Header row of each feed: (feed, header_row, names).

    By default the first row without a missing cell; a row with fewer cells than
    the usual width of its feed, the one that holds most filled cells, has missing
    cells. Where no row is complete, the widest narrower ones without an empty cell
    are asked. With ``value``, the first row holding it in the given column, counted
    from 1.
    """
    if value is not None:
        hits = lines.filter(F.get("cells", F.lit(column - 1)) == value)
        at = hits.groupBy("feed").agg(F.min("pos").alias("header_row"))
    else:
        given = lambda c: c.isNotNull() & (c != "")
        by_width = lines.groupBy("feed", F.size("cells").alias("__width")).agg(
            F.min(F.when(F.forall("cells", given), F.col("pos"))).alias("header_row"),
            F.sum(F.size(F.filter("cells", given))).alias("__filled"),
        )
        usual = by_width.groupBy("feed").agg(F.max_by("__width", F.struct("__filled", "__width")).alias("__usual"))
        wide = F.col("__width") >= F.col("__usual")
        narrower = F.when(~wide & F.col("header_row").isNotNull(), F.col("__width"))
        at = join_null_safe(by_width, usual, ["feed"]).groupBy("feed").agg(
            F.coalesce(F.min(F.when(wide, F.col("header_row"))), F.max_by("header_row", narrower)).alias("header_row")
        )
    # Positions are found by hashing; only then are the cells of those few rows taken.
    at = at.filter(F.col("header_row").isNotNull()).withColumnRenamed("header_row", "pos")
    found = join_null_safe(lines, at, ["feed", "pos"])
    return found.select("feed", F.col("pos").alias("header_row"), F.col("cells").alias("names"))


def header_to_names(
    lines: DataFrame,
    row: int | str = FIND_HEADER,
    remove_row: bool = True,
    remove_rows_above: bool = True,
    clean: bool = True,
) -> DataFrame:
    """Raise one row of each feed to be its column names.

    Feeds may list their columns in different order: cells are picked by name
    and the result has every name found. A feed that holds anything but has no
    such row is an error. The driver sees the distinct header rows only.
    """
    if row == FIND_HEADER:
        headers = find_header(lines)
    else:
        headers = lines.filter(F.col("pos") == row).select("feed", F.col("pos").alias("header_row"), F.col("cells").alias("names"))
    held = lines.groupBy("feed").agg(F.bool_or(F.exists("cells", lambda c: c.isNotNull() & (c != ""))).alias("__held"))
    lost = join_null_safe(held.filter("__held").select("feed"), headers.select("feed"), ["feed"], "left_anti")
    if lost := [r["feed"] for r in lost.limit(5).collect()]:
        raise ValueError(f"feeds without a header row: {lost}")
    layouts = [r["names"] for r in headers.select("names").distinct().collect()]
    named = [(given, clean_name_list(given) if clean else unique_names([n or "x" for n in given])) for given in layouts]
    columns = list(dict.fromkeys(c for _, columns in sorted(named, key=lambda pair: pair[1]) for c in columns))
    spelling = lines.sparkSession.createDataFrame(named, "names array<string>, __columns array<string>")
    headers = join_null_safe(headers, spelling, ["names"])
    rows = join_null_safe(lines, headers, ["feed"], "inner")
    if remove_row:
        rows = rows.filter(F.col("pos") != F.col("header_row"))
    if remove_rows_above:
        rows = rows.filter(F.col("pos") >= F.col("header_row"))
    # Short rows read as missing at the end.
    by_name = F.map_from_arrays("__columns", F.transform("__columns", lambda _, i: F.get("cells", i)))
    rows = rows.withColumn("__named", by_name)
    return rows.select("feed", "pos", *[F.try_element_at("__named", F.lit(c)).alias(c) for c in columns])


def typed(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast text columns; what cannot be read in the wanted type is missing."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def read_feed(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    skip: int = 0,
    types: Mapping[str, str] | None = None,
    clean: bool = True,
    **options,
) -> DataFrame:
    """Read a feed, skip leading lines, clean its names, type its columns.

    ``fmt`` is any Spark source, or ``table`` for a catalog table. Text arrives
    as strings and is typed by ``types``, so one bad cell costs one cell.
    """
    if fmt == "table":
        df = spark.table(path)
    elif fmt == "csv" and skip:
        df = header_to_names(read_lines(spark, path, options.get("sep", ",")), skip + 1, clean=clean).drop("feed", "pos")
    elif fmt == "csv":
        df = spark.read.csv(path, header=True, **options)
    else:
        df = spark.read.format(fmt).options(**options).load(path)
    df = clean_names(df) if clean else df
    return typed(df, types or {})


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Save a table as Parquet and go on from the saved copy.

    Later steps then read the copy instead of computing it again, also after the
    loss of an executor.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
