"""Work-entry and plan feeds derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktally.functions.scalars import fiscal_year, later_of
from worktally.session import stored

# Roles the test tables' values play in the pipelines.
NON_PROJECT = ("ECONOMY", "LARGE", "PROMO")
ADMIN = ("ECONOMY",)
DONE = "2001-06-04"
CHOSEN_PROJECT = "STANDARD"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def charges_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One work entry per line item; person is the supplier, project the part type."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", F.to_date("l_shipdate").alias("date")
    )
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_type", "p_brand", F.concat(F.lit("C"), F.col("p_size").cast("string")).alias("code")
    )
    monday = F.trunc("date", "week")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("person"),
        "date",
        F.when(F.col("l_linenumber") == 7, F.date_add(monday, 7)).otherwise(monday).alias("period"),
        F.col("p_type").alias("project"),
        F.col("p_brand").alias("subproject"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("code")).alias("code"),
        F.when(~((F.col("l_linenumber") == 5) & (F.col("l_quantity") == 50)), F.col("l_quantity") / 4).alias("hours"),
        F.when(F.year("date") < 1998, F.lit(7.5)).otherwise(F.lit(8.0)).alias("length"),
    )


def plan_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan sheet per fiscal year, project and subproject with open ends and gaps.

    Stored once, as a plan sheet is a feed of its own.
    """
    entries = charges_raw(spark, sf_dir).filter(F.col("hours").isNotNull())
    entries = entries.withColumn("date", later_of("date", "period"))
    keys = [fiscal_year("date").alias("year"), F.col("project"), F.col("subproject")]
    codes = entries.groupBy(*keys, "code").agg(
        F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("n")
    )
    plan = codes.groupBy("year", "project", "subproject").agg(
        F.min("first").alias("startdate"),
        F.max("last").alias("lastdate"),
        F.max("code").alias("code"),
        F.sum("n").alias("n"),
    )
    sub = F.col("subproject")
    plan = plan.select(
        "year",
        "project",
        "subproject",
        "startdate",
        F.when(sub != "Brand#1", F.col("lastdate")).alias("enddate"),
        "code",
        F.when(sub != "Brand#2", F.lit("S1")).alias("subcode"),
        F.when(sub != "Brand#3", F.col("n") / 4.0).alias("budgeted"),
        F.lit(119.0).alias("profile"),
    )
    return stored(plan, "plan_feed")
