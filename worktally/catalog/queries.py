"""Every registered query: (spark, folder of the tables) to DataFrame.

All of them read whole tables. Results are cast to types that read the same in
any engine: whole numbers as bigint, dates and timestamps as text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worktally.functions import aggregates as agg
from worktally.functions import dates, scalars
from worktally.functions.names import clean_names, normalize_values
from worktally.operators import adorn, cleaning, joins, quantiles, ranking, reports, reshape, stats, tabulate
from worktally.operators.fill import carry_forward, fill_down
from worktally.plans import charges as ch
from worktally.plans import monthly as mo
from worktally.plans import week_table as ts
from worktally.plans import weekly as wk
from worktally.session import shared_dir, stored
from worktally.sources import audit, feeds, samples
from worktally.sources.samples import ADMIN, CHOSEN_PROJECT, DONE, NON_PROJECT, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def portable(df: DataFrame) -> DataFrame:
    casts = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            casts[f.name] = F.col(f"`{f.name}`").cast("string")
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            casts[f.name] = F.col(f"`{f.name}`").cast("bigint")
    return df.withColumns(casts)


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return portable(fn(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return run


def with_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their label, missing where there is none."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left")


def six(c: Column | str, digits: int = 6) -> Column:
    """Digits on which two engines agree whatever the order of summation."""
    return F.round(scalars.as_col(c), digits)


# ------------------------------------------------------- charges and projects
@query
def prepare_charges(spark, sf):
    return ch.prepare_charges(samples.charges_raw(spark, sf), ["person"])[0]


@query
def fill_down_code(spark, sf):
    typed = ch.type_charges(samples.charges_raw(spark, sf))
    return fill_down(typed, "code", ["project"]).select("date", "project", "code", "hours")


@query
def carry_forward_events(spark, sf):
    """Small readings count as missing and take the last one of their kind."""
    events = table(spark, sf, "events").select("event_id", "event_type", "ts", F.when(F.col("value") >= 5, F.col("value")).alias("value"))
    return carry_forward(events, "value", ["event_type"], ["ts", "event_id"]).select("event_id", "event_type", "value")


@query
def quality_rejects(spark, sf):
    return ch.prepare_charges(samples.charges_raw(spark, sf), ["person"])[1]


@query
def freshness(spark, sf):
    return cleaning.freshness(ch.type_charges(samples.charges_raw(spark, sf)), "date")


@query
def charge_ledger(spark, sf):
    return ch.collapse(ch.charge_ledger(samples.charges_raw(spark, sf)))


@query
def snapshot_charges(spark, sf):
    typed = ch.type_charges(samples.charges_raw(spark, sf), ["person"])
    return feeds.snapshot(typed, f"{shared_dir(spark)}/worktally_charges_{sf.strip('/').split('/')[-1]}")


@query
def derive_projects(spark, sf):
    return ch.derive_projects(ch.charge_ledger(samples.charges_raw(spark, sf)))


@query
def prepare_projects(spark, sf):
    return ch.prepare_projects(samples.plan_raw(spark, sf))


@query
def blank_weeks(spark, sf):
    charges = ch.charge_ledger(samples.charges_raw(spark, sf))
    return ch.blank_weeks(charges, ch.derive_projects(charges)).drop("n", "missing")


@query
def combine_validity_join(spark, sf):
    charges, _ = ch.prepare_charges(samples.charges_raw(spark, sf))
    return ch.combine(charges).drop("n", "missing")


@query
def binned_validity_join(spark, sf):
    """Orders placed while an order of the same customer, itself included, is open for up to 400 days."""
    orders = table(spark, sf, "orders").withColumn("date", F.to_date("o_orderdate"))
    spans = orders.select("o_custkey", F.col("o_orderkey").alias("open_order"), F.col("date").alias("startdate"))
    spans = spans.withColumn("enddate", F.date_add("startdate", (F.col("open_order") % 400).cast("int")))
    return joins.binned_validity_join(orders.select("o_custkey", "o_orderkey", "date"), spans, ["o_custkey"])


def _plan_combined(spark, sf, need_hours=True):
    charges = ch.plan_ledger(samples.charges_raw(spark, sf), need_hours=need_hours)
    return ch.combine_with_plan(charges, ch.prepare_projects(samples.plan_raw(spark, sf)))


@query
def combine_with_plan(spark, sf):
    return _plan_combined(spark, sf)


@query
def full_outer_plan(spark, sf):
    """Hours beside every plan line of the year before; lines without hours and hours without a line stay."""
    hours = ch.plan_ledger(samples.charges_raw(spark, sf)).groupBy("year", "project").agg(agg.sum_lenient("hours").alias("hours"))
    plan = samples.plan_raw(spark, sf).select((F.col("year") + 1).alias("year"), "project", "subcode", "budgeted")
    return joins.join_null_safe(hours, plan, ["year", "project"], "full")


@query
def natural_left_join(spark, sf):
    days = ch.plan_ledger(samples.charges_raw(spark, sf)).groupBy("year", "project", "subproject").agg(F.sum("hours").alias("hours"))
    plan = ch.prepare_projects(samples.plan_raw(spark, sf)).select("year", "project", "subproject", "code", "subcode", "budgeted")
    return joins.natural_left_join(days, plan)


@query
def null_safe_join(spark, sf):
    """Counts per toxicity flag meet per-flag quality; the missing flag matches itself."""
    docs = with_labels(spark, sf)
    n = docs.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))
    good = docs.groupBy("toxic").agg(F.count("quality").alias("n_rated"))
    return joins.join_null_safe(n, good, ["toxic"], "left")


@query
def union_feeds(spark, sf):
    orders = table(spark, sf, "orders")
    done = orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", "o_orderpriority")
    rest = orders.filter("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey", "o_totalprice")
    return joins.union_feeds(done, rest)


# --------------------------------------------------------------- weekly balance
def _weekly(spark, sf, target, by=()):
    return wk.weekly_balance(ch.charge_ledger(samples.charges_raw(spark, sf), by), target, by)


@query
def weekly_constant(spark, sf):
    return _weekly(spark, sf, "constant")


@query
def weekly_current(spark, sf):
    return _weekly(spark, sf, "current")


@query
def weekly_cumulative(spark, sf):
    return _weekly(spark, sf, "cumulative")


@query
def weekly_lagged(spark, sf):
    return _weekly(spark, sf, "lagged")


@query
def weekly_cumulative_by_person(spark, sf):
    return _weekly(spark, sf, "cumulative", ["person"])


@query
def weekly_strict_missing(spark, sf):
    """Entries without hours are kept: they blank their week and what follows."""
    charges = ch.plan_ledger(samples.charges_raw(spark, sf), ["person"], need_hours=False)
    return wk.weekly_balance(charges, "current", ["person"])


# ------------------------------------------------------------------- week tables
@query
def week_table_v7(spark, sf):
    return ts.week_table(ch.combine(ch.charge_ledger(samples.charges_raw(spark, sf))), DONE, unlisted=ADMIN)


@query
def week_table_by_person(spark, sf):
    charges = ch.charge_ledger(samples.charges_raw(spark, sf), ["person"])
    return ts.week_table(charges, DONE, by=["person"], unlisted=ADMIN)


@query
def week_table_v4(spark, sf):
    ids = ["project", "subproject", "code", "subcode"]
    return ts.week_table(_plan_combined(spark, sf), DONE, ids=ids, unlisted=ADMIN).drop("Sheet")


@query
def week_table_v1(spark, sf):
    charges = ch.plan_ledger(samples.charges_raw(spark, sf), need_hours=False)
    return ts.week_table_planned(charges, ch.prepare_projects(samples.plan_raw(spark, sf)), DONE).drop("code")


@query
def week_table_printable(spark, sf):
    charges = ch.charge_ledger(samples.charges_raw(spark, sf))
    return ts.printable(ts.week_table(charges, DONE, unlisted=ADMIN)).select("period", "project", "code", "Mon", "Sun", "Total")


@query
def daily_hours(spark, sf):
    charges = ch.plan_ledger(samples.charges_raw(spark, sf), need_hours=False)
    return ts.daily(charges, ch.prepare_projects(samples.plan_raw(spark, sf)))


@query
def pivot_week(spark, sf):
    return reshape.pivot_week(ch.type_charges(samples.charges_raw(spark, sf)), ["period", "project"])


@query
def row_totals(spark, sf):
    wide = reshape.pivot_week(ch.type_charges(samples.charges_raw(spark, sf)), ["period", "project"])
    return reshape.row_totals(wide).select("period", "project", "Total")


@query
def spread_mean(spark, sf):
    orders = table(spark, sf, "orders").withColumn("whole", F.floor("o_totalprice"))
    return reshape.spread(orders, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], F.avg("whole"))


@query
def gather_long(spark, sf):
    orders = table(spark, sf, "orders")
    wide = reshape.spread(orders, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], F.count(F.lit(1)))
    return reshape.gather(wide, ["o_orderpriority"], ["F", "O", "P"], "status", "n")


@query
def complete_three_keys(spark, sf):
    keys = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    orders = table(spark, sf, "orders").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return reshape.complete_keys(orders, keys, {"n": 0})


# ---------------------------------------------------------- months, years, charts
@query
def complete_project_month(spark, sf):
    charges = ch.charge_ledger(samples.charges_raw(spark, sf), ["person"])
    sums = stored(charges.groupBy("person", "project", "month").agg(F.sum("hours").alias("hours")), "sums")
    return reshape.complete(sums, "project", "month", ["person"], {"hours": 0.0})


def _monthly(spark, sf, by=()):
    return mo.monthly(ch.combine(ch.charge_ledger(samples.charges_raw(spark, sf), by), by), by, NON_PROJECT)


def _budget(spark, sf, keep_npt):
    return mo.monthly_budget(_plan_combined(spark, sf, need_hours=keep_npt), npt=NON_PROJECT, keep_npt=keep_npt)


@query
def monthly_v7(spark, sf):
    return _monthly(spark, sf)


@query
def monthly_by_person(spark, sf):
    return _monthly(spark, sf, ["person"])


@query
def monthly_budget_v4(spark, sf):
    return _budget(spark, sf, keep_npt=False)


@query
def monthly_budget_v6(spark, sf):
    return _budget(spark, sf, keep_npt=True)


@query
def monthly_budget_v1(spark, sf):
    charges = ch.plan_ledger(samples.charges_raw(spark, sf), need_hours=False)
    lines = mo.monthly_budget_flat(charges, samples.plan_raw(spark, sf), npt=NON_PROJECT, moved=("2000-02-01", "2000-03-01"))
    return lines.withColumn("monthbudget", six("monthbudget"))


@query
def monthly_target_scale(spark, sf):
    lines = mo.monthly_target_scale(_plan_combined(spark, sf), npt=NON_PROJECT, moved=("2000-02-01", "2000-03-01"))
    return lines.withColumns({c: six(c) for c in ("monthtarget", "monthbudget2")})


@query
def yearly_totals_v7(spark, sf):
    return mo.yearly_totals(_monthly(spark, sf))


@query
def yearly_totals_v4(spark, sf):
    return mo.yearly_totals(_budget(spark, sf, keep_npt=False), budget=True, profile=True)


@query
def yearly_totals_v6(spark, sf):
    return mo.yearly_totals(_budget(spark, sf, keep_npt=True), budget=True)


@query
def project_months(spark, sf):
    return mo.project_months(_monthly(spark, sf), CHOSEN_PROJECT)


@query
def chart_weekly(spark, sf):
    return mo.chart_data(_weekly(spark, sf, "cumulative"), "weekly")


@query
def chart_monthly(spark, sf):
    return mo.chart_data(_monthly(spark, sf), "monthly")


@query
def chart_budget(spark, sf):
    return mo.chart_data(_budget(spark, sf, keep_npt=True), "budget")


# ------------------------------------------------- projections and expressions
@query
def sequential_columns(spark, sf):
    """Later columns see the earlier ones of the same step; membership is never missing."""
    raw = samples.charges_raw(spark, sf).select("person", "date", "period", "project", "code", "hours")
    step = raw.withColumn("date", scalars.later_of("date", "period")).withColumn("month", scalars.month_start("date"))
    return step.withColumns(
        {
            "year": scalars.fiscal_year("date"),
            "known_code": scalars.in_set("code", ["C1", "C2", "C3"]),
            "kind": scalars.if_else(scalars.in_set("project", NON_PROJECT), F.lit("NPT"), F.col("project")),
        }
    ).filter(F.col("hours") > 2)


@query
def scalar_texts(spark, sf):
    """Joined text with NA, first letter run, printed number."""
    raw = samples.charges_raw(spark, sf)
    return raw.select(
        scalars.paste("project", "code").alias("project2"),
        scalars.first_letters("subproject").alias("letters"),
        scalars.first_letters(F.col("hours").cast("string")).alias("none"),
        scalars.pad_cell("hours").alias("printed"),
    )


@query
def scalar_dates(spark, sf):
    raw = samples.charges_raw(spark, sf)
    return raw.select(
        "date",
        scalars.weekday_label("date").alias("label"),
        scalars.weekday_order("date").alias("place"),
        scalars.month_start("date").alias("month"),
        scalars.fiscal_year("date").alias("year"),
        scalars.remap_month("date", "2000-02-01", "2000-03-01").alias("moved"),
    ).distinct()


@query
def week_grid(spark, sf):
    weeks = samples.charges_raw(spark, sf).select("period").distinct()
    return weeks.withColumn("day", F.explode(scalars.week_days("period")))


@query
def null_helpers(spark, sf):
    raw = samples.charges_raw(spark, sf)
    return raw.select(
        "person",
        scalars.zero_to_null(F.col("hours") - 5).alias("positive"),
        scalars.null_to_zero("hours").alias("or_zero"),
        scalars.clamp_zero(F.col("hours") - 5).alias("clamped"),
        scalars.clamp_zero(F.col("hours") - 5, keep_missing=True).alias("clamped_missing"),
    )


@query
def coalesce_first(spark, sf):
    docs = with_labels(spark, sf)
    return docs.select("doc_id", scalars.coalesce_first("quality", "toxic", F.lit(-1)).alias("first_known"))


@query
def null_if(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select("o_orderkey", scalars.null_if("o_orderpriority", ["4-NOT SPECIFIED", "NA"]).alias("priority"))


@query
def fill_const(spark, sf):
    return cleaning.fill_const(with_labels(spark, sf), {"quality": 0, "toxic": -1})


@query
def fill_with_max(spark, sf):
    plan = samples.plan_raw(spark, sf).select("year", "project", "subproject", "enddate")
    return cleaning.fill_with_max(plan, "enddate")


@query
def drop_missing(spark, sf):
    return cleaning.drop_missing(samples.charges_raw(spark, sf), ["code", "hours"])


@query
def apply_to_columns(spark, sf):
    plan = samples.plan_raw(spark, sf).select("project", "subproject", "budgeted", "profile")
    return cleaning.apply_to(plan, scalars.pad_cell)


@query
def sort_missing_last(spark, sf):
    plan = samples.plan_raw(spark, sf).select("year", "project", "subproject", "budgeted")
    return plan.orderBy("year", F.desc_nulls_last("budgeted"), "project", "subproject")


@query
def rename_count(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").count()
    return counts.withColumnRenamed("count", "proportion")


# ------------------------------------------------------------------ aggregates
@query
def strict_vs_lenient_aggs(spark, sf):
    raw = samples.charges_raw(spark, sf)
    return raw.groupBy("person", "project").agg(
        agg.sum_strict("hours").alias("sum_strict"),
        agg.sum_lenient("hours").alias("sum_lenient"),
        agg.median_strict("hours").alias("median_strict"),
        agg.median_lenient("hours").alias("median_lenient"),
        agg.mean_lenient("hours").alias("mean_lenient"),
        agg.sum_where("hours", F.col("code").isNull()).alias("sum_uncoded"),
        F.min("date").alias("first_date"),
        F.max("code").alias("max_code"),
        F.bool_or(F.col("hours").isNull()).alias("any_missing"),
        F.bool_and(F.col("hours") > 0).alias("all_positive"),
        agg.proportion(F.col("hours") > 6).alias("share_long"),
    )


@query
def group_median(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("cents", F.round(F.col("l_extendedprice") * 100))
    return quantiles.group_median(lines, ["l_returnflag"], "cents")


@query
def group_quantiles_price(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("cents", F.round(F.col("l_extendedprice") * 100))
    out = quantiles.group_quantiles(lines, ["l_returnflag", "l_linestatus"], "cents", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return out.withColumns({c: six(c, 3) for c in ("p10", "p50", "p90")})


@query
def n_distinct_null(spark, sf):
    return samples.charges_raw(spark, sf).groupBy("person").agg(agg.n_distinct("code").alias("n_codes"))


@query
def distinct_weeks(spark, sf):
    return ch.charged_weeks(ch.type_charges(samples.charges_raw(spark, sf)))


@query
def group_values_to_rows(spark, sf):
    lines = ch.type_charges(samples.charges_raw(spark, sf)).groupBy("project", "month").agg(F.sum("hours").alias("hours"))
    lines = joins.attach_group(lines, ["month"], month_hours=F.sum("hours"))
    return joins.attach_group(lines, [], all_hours=F.sum("hours"))


@query
def first_appearance_rank(spark, sf):
    lines = samples.plan_raw(spark, sf).groupBy("year", "subproject").agg(F.sum("budgeted").alias("budget"))
    return ranking.first_appearance_rank(lines, "subproject", "year", "budget")


@query
def share_scaling(spark, sf):
    plan = samples.plan_raw(spark, sf).select("year", "project", "subproject", "budgeted")
    counted = ~scalars.in_set("project", NON_PROJECT)
    return ranking.share_scaling(plan, "budgeted", 101.0, ["year"], "scaled", counted)


@query
def number_rows(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return ranking.numbered(lines, ["l_returnflag"], order)


# ----------------------------------------------------------------- tabulations
@query
def tabyl_one_way(spark, sf):
    return tabulate.tabyl_one(table(spark, sf, "orders"), "o_orderpriority")


@query
def tabyl_one_way_na(spark, sf):
    return tabulate.tabyl_one(with_labels(spark, sf), "quality")


@query
def tabyl_hide_na(spark, sf):
    return tabulate.tabyl_one(with_labels(spark, sf), "quality", show_na=False)


@query
def tabyl_two_way(spark, sf):
    tab = tabulate.tabyl(with_labels(spark, sf), "lang", "quality")
    return tab.wide(levels=[0, 1, None])


@query
def tabyl_three_way(spark, sf):
    customers = table(spark, sf, "customer").join(
        table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey"
    ).withColumn("solvent", F.col("c_acctbal") > 0)
    return tabulate.tabyl(customers, "c_mktsegment", "n_regionkey", "solvent").counts()


@query
def tabyl_missing_levels(spark, sf):
    levels = [*PRIORITIES, "6-NEVER"]
    return tabulate.tabyl_one(table(spark, sf, "orders"), "o_orderpriority", levels)


@query
def tabyl_two_way_levels(spark, sf):
    tab = tabulate.tabyl(
        table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", row_levels=["F", "O", "P", "X"], col_levels=[*PRIORITIES, "6-NEVER"]
    )
    return tab.counts()


def _orders_tab(spark, sf):
    return tabulate.tabyl(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query
def tabyl_column_named_n(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("row_total"), F.col("o_orderpriority").alias("n"))
    return tabulate.tabyl(orders, "row_total", "n").adorn_totals().wide()


@query
def tabyl_column_named_value(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("value"), F.col("o_orderpriority").alias("n"))
    return tabulate.tabyl(orders, "value", "n").adorn_percentages("row").cells


@query
def tabyl_one_way_named_n(spark, sf):
    return tabulate.tabyl_one(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("n")), "n")


@query
def tabyl_label_clash(spark, sf):
    names = F.array(*map(F.lit, ["NA_", "Total", "", None, "other"]))
    docs = table(spark, sf, "documents").select("lang", F.get(names, (F.col("doc_id") % 5).cast("int")).alias("mark"))
    return tabulate.tabyl(docs, "lang", "mark").adorn_totals("col").wide()


@query
def tabyl_ordered_levels(spark, sf):
    order = ["5-LOW", "1-URGENT"]
    tab = tabulate.tabyl(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", row_levels=order, col_levels=["P", "X"]).adorn_totals("row")
    return tab.wide()


@query
def adorn_totals_both(spark, sf):
    return _orders_tab(spark, sf).adorn_totals(["row", "col"]).wide(PRIORITIES)


@query
def adorn_totals_long(spark, sf):
    tab = tabulate.tabyl(with_labels(spark, sf), "lang", "quality", "source").adorn_totals()
    return tab.cells.drop("value")


def _shares(spark, sf, denominator):
    tab = tabulate.tabyl(table(spark, sf, "lineitem"), "l_returnflag", "l_linenumber").adorn_percentages(denominator)
    return tab.cells.select("l_returnflag", "l_linenumber", "n", F.col("value").alias("share"))


@query
def adorn_pct_row(spark, sf):
    return _shares(spark, sf, "row")


@query
def adorn_pct_col(spark, sf):
    return _shares(spark, sf, "col")


@query
def adorn_pct_all(spark, sf):
    return _shares(spark, sf, "all")


@query
def adorn_rounding(spark, sf):
    return _orders_tab(spark, sf).adorn_percentages("all").adorn_rounding(3, "half up").wide(PRIORITIES)


@query
def adorn_pct_text(spark, sf):
    return _orders_tab(spark, sf).adorn_percentages("col").adorn_pct_formatting(2, "half up").wide(PRIORITIES)


@query
def adorn_ns(spark, sf):
    tab = _orders_tab(spark, sf).adorn_percentages("row").adorn_pct_formatting(0, "half up")
    return tab.adorn_ns("front").wide(PRIORITIES)


@query
def adorn_full_chain(spark, sf):
    tab = _orders_tab(spark, sf).adorn_totals(["row", "col"]).adorn_percentages("row")
    return tab.adorn_pct_formatting(1, "half up").adorn_ns().adorn_title("combined", "Status", "Priority").wide(PRIORITIES)


@query
def adorn_one_way(spark, sf):
    tab = tabulate.tabyl_one(with_labels(spark, sf), "lang").drop("valid_percent")
    return adorn.adorn_pct_formatting(adorn.adorn_totals(tab, "row"), 1, "half up", cols=["percent"])


@query
def adorn_three_way(spark, sf):
    tab = tabulate.tabyl(table(spark, sf, "lineitem"), "l_linestatus", "l_linenumber", "l_returnflag")
    tab = tab.adorn_totals("row").adorn_percentages("all").adorn_pct_formatting(1, "half up").adorn_ns().adorn_title()
    return tab.wide(list(range(1, 8)))


@query
def adorn_chosen_column(spark, sf):
    """Counts renamed and turned into column shares; other numbers stay."""
    frame = table(spark, sf, "orders").groupBy("o_orderstatus", F.year("o_orderdate").alias("year")).count()
    frame = frame.withColumnRenamed("count", "proportion")
    return adorn.adorn_pct_formatting(adorn.adorn_percentages(frame, "col", cols=["proportion"]), 1, "half up", cols=["proportion"])


@query
def adorn_any_frame(spark, sf):
    """Totals on chosen columns of a frame that is not a tabulation."""
    nations = table(spark, sf, "nation").join(
        table(spark, sf, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), "n_nationkey"
    )
    frame = nations.groupBy("n_name", "n_regionkey").agg(
        F.count_if(F.col("c_acctbal") > 0).alias("solvent"), F.count_if(F.col("c_acctbal") <= 0).alias("owing")
    )
    return adorn.adorn_totals(frame, ["col", "row"], name="Total Cases", cols=["solvent", "owing"])


@query
def adorn_frame_shares(spark, sf):
    frame = reshape.spread(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], F.count(F.lit(1)))
    return adorn.adorn_pct_formatting(adorn.adorn_percentages(frame, "col"), 1, "half up")


@query
def adorn_frame_ns(spark, sf):
    orders = table(spark, sf, "orders").withColumn("whole", F.floor("o_totalprice"))
    means = reshape.spread(orders, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], F.avg("whole"))
    ns = _orders_frame(orders)
    return adorn.adorn_title(adorn.adorn_ns(adorn.adorn_rounding(means, 0, "half up"), ns), "Priority", "Status")


@query
def adorn_frame_totals_then_shares(spark, sf):
    frame = adorn.remembered(_orders_frame(table(spark, sf, "orders")))
    return adorn.plain(adorn.adorn_percentages(adorn.adorn_totals(frame, ["row", "col"]), "col"))


@query
def adorn_frame_totals_ns(spark, sf):
    frame = adorn.adorn_totals(adorn.remembered(_orders_frame(table(spark, sf, "orders"))), ["row", "col"])
    frame = adorn.adorn_pct_formatting(adorn.adorn_percentages(frame, "all"), 0, "half up").orderBy("o_orderpriority")
    return adorn.plain(adorn.adorn_ns(frame))


def _orders_frame(orders):
    return reshape.spread(orders, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], F.count(F.lit(1)))


@query
def top_levels_priority(spark, sf):
    return tabulate.top_levels(table(spark, sf, "orders"), "o_orderpriority", PRIORITIES)


@query
def quantile_bins_price(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return quantiles.quantile_bins(orders, "o_totalprice", [0, 1 / 3, 2 / 3, 1], "third", ["low", "middle", "high"])


# ------------------------------------------------------------------- tests
@query
def chisq_stat(spark, sf):
    tab = _orders_tab(spark, sf).adorn_totals()
    return stats.chisq_stat(tab).withColumn("statistic", six("statistic"))


@query
def chisq_2x2_corrected(spark, sf):
    tab = tabulate.tabyl(table(spark, sf, "labels"), "quality", "toxic")
    return stats.chisq_stat(tab).withColumn("statistic", six("statistic"))


@query
def chisq_pvalue(spark, sf):
    orders = table(spark, sf, "orders")
    return stats.chisq_test(orders, "o_orderstatus", "o_orderpriority").withColumns({c: six(c) for c in ("statistic", "p_value")})


@query
def fisher_by_group(spark, sf):
    docs = with_labels(spark, sf).filter(F.col("quality").isNotNull())
    return stats.fisher_test_2x2(docs, ["lang"], "quality", "toxic").withColumn("p_value", six("p_value", 8))


# ---------------------------------------------------------- cleaning, relations
@query
def get_dupes_lineitem(spark, sf):
    return cleaning.get_dupes(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def get_dupes_text(spark, sf):
    return cleaning.get_dupes(table(spark, sf, "documents"), ["text"], wide=True).drop("text")


@query
def get_dupes_all_columns(spark, sf):
    return cleaning.get_dupes(table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag"))


def _customers(spark, sf):
    nations = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    regions = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return table(spark, sf, "customer").join(nations, "c_nationkey").join(regions, "n_regionkey")


@query
def single_value_report(spark, sf):
    return cleaning.single_value_report(samples.charges_raw(spark, sf), ["person", "project", "subproject"], "code")


@query
def single_value_fill(spark, sf):
    region = F.when(F.col("c_acctbal") > 1000, F.col("r_name"))
    rows = _customers(spark, sf).select("c_custkey", "n_name", region.alias("region"))
    return cleaning.single_value(rows, ["n_name"], "region")


@query
def fill_with_max_by(spark, sf):
    known = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal"))
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", known.alias("c_acctbal"))
    return cleaning.fill_with_max(rows, "c_acctbal", ["c_nationkey"])


@query
def one_to_one_columns(spark, sf):
    rows = _customers(spark, sf)
    return cleaning.get_one_to_one(rows, ["c_custkey", "c_name", "c_nationkey", "n_name", "n_regionkey", "r_name", "c_mktsegment"])


def _gappy_orders(spark, sf):
    f = F.col("o_orderstatus") == "F"
    return table(spark, sf, "orders").select(
        F.when(~f, F.col("o_orderkey")).alias("key"),
        F.when(~f, F.col("o_totalprice")).alias("price"),
        F.lit(None).cast("string").alias("nothing"),
        F.when(~f & (F.col("o_orderpriority") > "3"), F.col("o_orderpriority")).alias("priority"),
        F.lit("x").alias("constant"),
    )


@query
def remove_empty_rows(spark, sf):
    return cleaning.remove_empty(_gappy_orders(spark, sf).drop("constant"), "rows")


@query
def remove_empty_cols(spark, sf):
    return cleaning.remove_empty(_gappy_orders(spark, sf), "cols")


@query
def remove_empty_cutoff(spark, sf):
    return cleaning.remove_empty(_gappy_orders(spark, sf), ["rows", "cols"], 0.4)


@query
def remove_constant(spark, sf):
    return cleaning.remove_constant(_gappy_orders(spark, sf), na_rm=True)


# ------------------------------------------------------------ dates, rounding
@query
def excel_dates(spark, sf):
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date")).cast("double")
    part = F.col("o_orderkey") % 96 / 96
    orders = table(spark, sf, "orders").select("o_orderkey", days.alias("day"), (days + part).alias("moment"))
    return orders.select(
        "o_orderkey",
        dates.excel_date("moment").alias("modern"),
        dates.excel_date(F.col("day") - 1462, "mac pre-2011").alias("mac"),
        dates.excel_date("moment", include_time=True).alias("with_time"),
        # Serials from the order number reach back to the false leap day.
        dates.excel_date(F.col("o_orderkey") + 1).alias("early"),
    )


@query
def sas_dates(spark, sf):
    orders = table(spark, sf, "orders")
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1960-01-01").cast("date"))
    return orders.select(
        "o_orderkey",
        dates.sas_date(days).alias("day"),
        dates.sas_timestamp(days * 86400 + F.col("o_orderkey") % 86400).alias("moment"),
        (F.extract(F.lit("HOUR"), dates.sas_time(F.col("o_orderkey") % 86400))).cast("bigint").alias("hour"),
    )


@query
def mixed_dates_report(spark, sf):
    key = F.col("o_orderkey")
    text = (
        F.when(key % 7 == 0, F.lit("no date")).when(key % 7 == 1, F.lit(None)).when(key % 7 == 2, (key % 90 - 5).cast("string"))
        .when(key % 7 == 3, F.date_format(F.to_date("o_orderdate"), "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    return reports.read_dates(table(spark, sf, "orders").select(text.alias("text")), {"text": "day"}).report()


@query
def quality_report(spark, sf):
    gate = reports.quality_report(with_labels(spark, sf), ["quality", "lang"])
    counts = spark.createDataFrame([(gate.counts["rows"], gate.counts["rejected"], gate.counts["missing quality"])], "rows bigint, rejected bigint, missing_quality bigint")
    return gate.rejected.groupBy("source").agg(F.count(F.lit(1)).alias("rejects")).join(counts, F.col("rejects") <= F.col("rows"))


@query
def mixed_dates(spark, sf):
    day = F.to_date("o_orderdate")
    serial = F.datediff(day, F.lit("1899-12-30").cast("date"))
    text = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(serial.cast("string"), F.lit(".25")))
        .when(F.col("o_orderkey") % 4 == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 4 == 2, F.date_format(day, "yyyy-MM-dd 06:00:00"))
        .otherwise(F.lit("no date"))
    )
    orders = table(spark, sf, "orders").select("o_orderkey", text.alias("text"))
    return orders.select(
        "o_orderkey", dates.to_date_mixed("text").alias("day"), dates.to_timestamp_mixed("text").alias("moment")
    )


@query
def rounding_suite(spark, sf):
    half = F.col("l_quantity") / 2
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        scalars.round_half_even(half).alias("half_even"),
        scalars.round_half_up(half).alias("half_up"),
        scalars.round_half_up(-half).alias("half_up_negative"),
        scalars.signif_half_up(F.floor("l_extendedprice"), 2).alias("two_digits"),
        scalars.round_to_fraction(F.col("l_discount"), 4).alias("quarters"),
        scalars.round_to_fraction(F.col("l_quantity") / 7, 3, 2).alias("thirds"),
    )


# --------------------------------------------------------------- names, feeds
@query
def clean_names_orders(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return clean_names(orders.toDF("Order Key", "custKey", "% Total (2009)"))


@query
def normalize_values_part(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.concat_ws(" % ", F.upper("p_name"), "p_brand").alias("text"))
    return normalize_values(parts, "text", "clean")


@query
def normalize_values_taken(spark, sf):
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Size "), F.col("p_size"))).otherwise(F.lit("size"))
    return normalize_values(table(spark, sf, "part").select("p_partkey", text.alias("text")), "text", "clean", order=["p_partkey"])


@query
def normalize_values_numbered(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("text"))
    return normalize_values(parts, "text", "clean", order=["p_partkey"])


def order_lines(spark, sf):
    """Orders as exported lines: per status a title, a blank row, a header, rows."""
    orders = table(spark, sf, "orders")
    none = F.lit(None).cast("string")

    def line(pos: int, *cells: Column) -> Column:
        return F.struct(F.lit(pos).cast("bigint").alias("pos"), F.array(*cells).alias("cells"))

    body = orders.select(
        F.col("o_orderstatus").alias("feed"),
        (F.col("o_orderkey") + 4).alias("pos"),
        F.array(
            F.col("o_orderkey").cast("string"),
            F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")),
            F.col("o_custkey").cast("string"),
        ).alias("cells"),
    )
    first_name = F.when(F.col("feed") == "O", F.lit("orderKey")).otherwise(F.lit("Order Key"))
    top = F.array(
        line(1, F.concat(F.lit("Export "), "feed"), none, none),
        line(2, none, none, none),
        line(3, first_name, F.lit("Priority"), F.lit("Customer #")),
    )
    top = orders.select(F.col("o_orderstatus").alias("feed")).distinct().select("feed", F.inline(top))
    return top.unionByName(body)


@query
def find_header(spark, sf):
    found = feeds.find_header(order_lines(spark, sf))
    return found.select("feed", "header_row", F.concat_ws("|", "names").alias("names"))


@query
def find_header_value(spark, sf):
    found = feeds.find_header(order_lines(spark, sf), value="Priority", column=2)
    return found.select("feed", "header_row")


@query
def header_to_names(spark, sf):
    return feeds.header_to_names(order_lines(spark, sf)).drop("pos")


def _order_feeds(spark, sf):
    orders = table(spark, sf, "orders")
    return {
        "closed": orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", "o_orderpriority"),
        "open": orders.filter("o_orderstatus = 'O'").select(
            "o_orderkey", F.col("o_totalprice").cast("string"), F.col("o_custkey").cast("int").alias("o_custkey")
        ),
        "partial": orders.filter("o_orderstatus = 'P'").select(
            "o_orderkey",
            F.when(F.col("o_custkey") % 10 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
            "o_custkey",
        ),
    }


@query
def audit_feeds(spark, sf):
    return audit.audit_feeds(_order_feeds(spark, sf))


@query
def audit_feeds_mismatch(spark, sf):
    return audit.audit_feeds(_order_feeds(spark, sf), show="mismatch", mode="strict")


@query
def feeds_match(spark, sf):
    """Per column: may the feeds be stacked, by the labels of the audit."""
    found = audit.audit_feeds(_order_feeds(spark, sf))
    return found.groupBy("column_name").agg(F.bool_and("agrees").alias("agrees"), F.sum("n_misfits").alias("n_misfits"))
