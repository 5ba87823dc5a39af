"""Joins, cleaning, filling, reshaping, ranking and quantiles."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from worktally.operators import cleaning, joins, quantiles, ranking, reshape
from worktally.operators.fill import fill_down
from worktally.session import stored

DAY = dt.date(2024, 1, 1)


def test_null_safe_joins(spark, rows):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (4, "r")], "k int, b string")
    assert rows(joins.join_null_safe(a, b, ["k"])) == [(1, "x", "p"), (None, "y", "q")]
    assert rows(joins.join_null_safe(a, b, ["k"], "left")) == [(1, "x", "p"), (3, "z", None), (None, "y", "q")]
    assert rows(joins.join_null_safe(a, b, ["k"], "full"), "k", "a", "b") == [
        (1, "x", "p"), (3, "z", None), (4, None, "r"), (None, "y", "q"),
    ]
    assert rows(joins.natural_left_join(a, b)) == [(1, "x", "p"), (3, "z", None), (None, "y", "q")]
    assert rows(joins.join_null_safe(a, b, ["k"], "left_anti")) == [(3, "z")]


def test_null_safe_join_is_an_equi_join(spark):
    a = spark.range(10).selectExpr("nullif(id, 3) AS k", "id AS a")
    b = spark.range(10).selectExpr("nullif(id, 4) AS k", "id AS b")
    plan = joins.join_null_safe(a, b, ["k"], "left")._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in plan or "SortMergeJoin" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_validity_join(spark, rows):
    days = spark.createDataFrame([("a", DAY), ("a", DAY + dt.timedelta(9)), ("b", DAY)], "k string, date date")
    ranges = spark.createDataFrame(
        [("a", DAY, DAY + dt.timedelta(3), 1), ("a", DAY, None, 2), ("b", DAY, DAY, 3)], "k string, startdate date, enddate date, v int"
    )
    assert rows(joins.validity_join(days, ranges, ["k"]), "k", "date", "v") == [("a", DAY, 1), ("b", DAY, 3)]


def test_attach_group(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 5), (None, 6)], "k string, x int")
    assert rows(joins.attach_group(df, ["k"], s=F.sum("x"))) == [("a", 1, 3), ("a", 2, 3), (None, 5, 11), (None, 6, 11)]
    assert rows(joins.attach_group(df, [], s=F.sum("x")), "x", "s") == [(1, 14), (2, 14), (5, 14), (6, 14)]


def test_quality_gate_and_fills(spark, rows):
    df = spark.createDataFrame([("a", "c", 1.0), (None, "c", 2.0), ("a", None, float("nan"))], "p string, c string, x double")
    good, bad = cleaning.quality_gate(df, ["p", "c"])
    assert rows(good, "p", "c") == [("a", "c")]
    assert rows(bad, "p", "c") == [("a", None), (None, "c")]
    assert rows(cleaning.nan_to_null(df), "x") == [(1.0,), (2.0,), (None,)]
    assert rows(cleaning.fill_const(df, {"p": "No"}), "p") == [("No",), ("a",), ("a",)]
    plan = spark.createDataFrame([(1, DAY), (2, None)], "i int, enddate date")
    assert rows(cleaning.fill_with_max(plan, "enddate")) == [(1, DAY), (2, DAY)]


def test_remove_empty_and_constant(spark, rows):
    q = spark.createDataFrame([(1.0, None, "a"), (None, None, None), (3.0, None, "b")], "v1 double, v2 string, v3 string")
    out = cleaning.remove_empty(q)
    assert out.columns == ["v1", "v3"] and rows(out) == [(1.0, "a"), (3.0, "b")]
    assert cleaning.remove_empty(q, "cols", 1 / 3).columns == []
    a = spark.createDataFrame([(1, "s", "t", None), (2, "s", None, None)], "good int, boring string, holed string, nothing string")
    assert cleaning.remove_constant(a).columns == ["good", "holed"]
    assert cleaning.remove_constant(a, na_rm=True).columns == ["good"]


def test_dupes(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (None, "b", 3), (None, "b", 4), (None, "b", 5), (2, "a", 6)], "k int, s string, v int")
    for wide in (False, True):
        got = [tuple(r) for r in cleaning.get_dupes(df, ["k", "s"], wide=wide).collect()]
        assert got == [(None, "b", 3, 3), (None, "b", 3, 4), (None, "b", 3, 5), (1, "a", 2, 1), (1, "a", 2, 2)]
    assert cleaning.get_dupes(df).count() == 0


def test_dupes_with_shifted_keys_do_not_collide(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    assert cleaning.get_dupes(df, ["x", "y"], wide=True).count() == 0


def test_single_value(spark, rows):
    good = spark.createDataFrame([(1, "a"), (1, None), (2, None)], "k int, v string")
    assert rows(cleaning.single_value(good, ["k"], "v")) == [(1, "a"), (1, "a"), (2, None)]
    bad = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (2, 2), (3, 1), (3, 2)], "X int, Y int")
    assert rows(cleaning.single_value_report(bad, ["X"], "Y")) == [(3, 1, 2, 2)]
    with pytest.raises(PySparkException, match="more than one value for X = 3"):
        cleaning.single_value(bad, ["X"], "Y", info="Calculating Z").collect()


def test_one_to_one(spark, rows):
    df = spark.createDataFrame(
        [("Luke", 172, "blond", "x", 1), ("C-3PO", 167, None, "y", 1), ("R2-D2", 96, None, "z", 2), ("Vader", 202, "none", "w", 1)],
        "name string, height int, hair string, id string, flag int",
    )
    assert rows(cleaning.get_one_to_one(df)) == [(1, "height"), (1, "id"), (1, "name")]


def test_one_to_one_with_missing_values_on_both_sides(spark, rows):
    df = spark.createDataFrame([(None, "v", 1), ("v", None, 1), (None, "v", 2)], "a string, b string, c int")
    assert rows(cleaning.get_one_to_one(df)) == [(1, "a"), (1, "b")]


def test_one_to_one_counts_few_of_many_columns(spark, rows, monkeypatch):
    df = spark.range(2_000).selectExpr(*[f"hash(id, {i}) % {3 + i * 7} AS c{i}" for i in range(200)]).selectExpr("*", "c7 * 10 AS twin", "cast(c150 AS string) AS `text 150`")
    counted, plain = [], cleaning.F.count_distinct
    monkeypatch.setattr(cleaning.F, "count_distinct", lambda *a: counted.append(a) or plain(*a))
    assert rows(cleaning.get_one_to_one(df)) == [(1, "c7"), (1, "twin"), (2, "c150"), (2, "text 150")]
    assert len(counted) < 20


def test_one_to_one_needs_more_than_equal_counts(spark, rows):
    df = spark.createDataFrame([(1, "a", 10), (1, "b", 10), (2, "a", 20)], "x int, y string, z int")
    assert rows(cleaning.get_one_to_one(df)) == [(1, "x"), (1, "z")]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(st.sampled_from(["p", "q", None]), st.integers(0, 6), st.sampled_from(["A", "B", "C", None])), min_size=1, max_size=40
    )
)
def test_fill_down_equals_row_level_carry(spark, entries):
    data = [(i, p, DAY + dt.timedelta(d), c) for i, (p, d, c) in enumerate(entries)]
    df = spark.createDataFrame(data, "i int, project string, date date, code string")
    got = {r["i"]: r["code"] for r in fill_down(df, "code", ["project"]).collect()}
    want, last = {}, {}
    for i, p, d, c in sorted(data, key=lambda r: (r[2], r[3] is None, r[3] or "")):
        last[p] = c if c is not None else last.get(p)
        want[i] = last[p]
    assert got == want


def test_fill_down_window_sees_days_not_records(spark):
    df = spark.range(1000).selectExpr("'hot' AS project", "date_add(date'2024-01-01', int(id % 5)) AS date", "if(id % 7 = 0, 'C', NULL) AS code")
    plan = fill_down(df, "code", ["project"])._jdf.queryExecution().optimizedPlan().toString()
    window, below = plan.split("Window [", 1)
    assert "Aggregate" in below


def test_complete(spark, rows):
    df = spark.createDataFrame([("a", 1, 2.0, "x"), ("b", 2, None, None), (None, 1, 5.0, "y")], "k string, m int, v double, s string")
    assert rows(reshape.complete(df, "k", "m", fill={"v": 0.0})) == [
        ("a", 1, 2.0, "x"), ("a", 2, 0.0, None), ("b", 1, 0.0, None), ("b", 2, 0.0, None), (None, 1, 5.0, "y"), (None, 2, 0.0, None),
    ]
    by = df.withColumn("g", F.when(F.col("k") == "b", 2).otherwise(1))
    assert rows(reshape.complete(by, "k", "m", ["g"]).select("g", "k", "m")) == [(1, "a", 1), (1, None, 1), (2, "b", 2)]


@pytest.mark.parametrize("pieces", [1_024, 2, 1])
def test_complete_keeps_repeated_rows_in_any_number_of_pieces(spark, rows, monkeypatch, pieces):
    monkeypatch.setattr(reshape, "AXIS_PIECES", pieces)
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("b", None)], "k string, m int")
    want = [("a", 1), ("a", 1), ("a", 2), ("a", None), ("b", 1), ("b", 2), ("b", None)]
    assert rows(reshape.complete(df, "k", "m")) == want
    by = df.withColumn("g", F.when(F.col("k") == "a", 1))
    assert rows(reshape.complete(by, "k", "m", ["g"]).select("k", "m")) == [("a", 1), ("a", 1), ("b", 2), ("b", None)]
    assert rows(reshape.complete(df.limit(0), "k", "m")) == []


def test_pivot_week_and_totals(spark, rows):
    df = spark.createDataFrame([("a", DAY, 1.0), ("a", DAY, 2.0), ("a", DAY + dt.timedelta(6), 4.0)], "p string, date date, hours double")
    wide = reshape.row_totals(reshape.pivot_week(df, ["p"]))
    assert wide.columns == ["p", *reshape.WEEKDAYS, "Total"]
    assert rows(wide) == [("a", 3.0, None, None, None, None, None, 4.0, 7.0)]


def test_numbered_equals_row_number(spark):
    from pyspark.sql import Window

    df = spark.range(500).selectExpr("id % 3 AS g", "if(id % 50 = 0, NULL, id * id % 97) AS x", "id")
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy(F.col("x").asc_nulls_last(), "id")))
    got = ranking.numbered(want, ["g"], ["x", "id"])
    assert got.filter("w <> seq").count() == 0 and got.count() == 500
    same = df.withColumn("x", F.lit(1))
    assert ranking.numbered(same, ["g"], ["x", "id"]).agg(F.max("seq")).first()[0] == 167
    by_text = df.withColumn("t", F.concat(F.lit("k"), F.lpad("id", 4, "0")))
    assert ranking.numbered(by_text, [], ["t"]).filter("seq <> id + 1").count() == 0
    assert ranking.numbered(df.limit(0), ["g"], ["x"]).count() == 0


@pytest.mark.parametrize("leading", ["if(id = 0, 1e15, id)", "7"])
def test_numbered_spreads_outliers_and_hot_values(spark, monkeypatch, leading):
    tables = []
    # Spark would merge ranges as small as these.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(ranking, "stored", lambda df, label: tables.append(df) or stored(df, label))
    df = spark.range(4000).selectExpr(f"{leading} AS x", "id")
    out = ranking.numbered(df, [], ["x", "id"])
    assert out.agg(F.count_distinct("seq"), F.min("seq"), F.max("seq")).first()[:] == (4000, 1, 4000)
    pieces = tables[0].groupBy(F.shiftright("__id", 33)).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(pieces) > 2 and max(r["count"] for r in pieces) < 2000


def test_first_appearance_rank(spark, rows):
    df = spark.createDataFrame(
        [("a", 1, 5.0), ("b", 1, 9.0), ("c", 2, 99.0), ("d", 1, None), ("e", 1, 5.0)], "p string, m int, w double"
    )
    assert rows(ranking.first_appearance_rank(df, "p", "m", "w")) == [("a", 2), ("b", 1), ("c", 5), ("d", 4), ("e", 3)]


def test_share_scaling_of_nothing(spark, rows):
    df = spark.createDataFrame([("a", 0.0), ("b", 2.0)], "g string, v double")
    assert rows(ranking.share_scaling(df, "v", 10.0, ["g"], "s")) == [("a", 0.0, None), ("b", 2.0, 10.0)]


@pytest.mark.parametrize("kind", ["smooth", "hot", "two hot"])
def test_quantiles_by_narrowing_are_exact(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "SORT_LIMIT", 20)
    value = {
        "smooth": "double(id * 7919 % 2003)",
        "hot": "if(id % 3 = 0, 500.0D, double(id * 7919 % 2003))",
        "two hot": "CASE id % 3 WHEN 0 THEN 500.0D WHEN 1 THEN 900.0D ELSE double(id * 7919 % 2003) END",
    }[kind]
    df = spark.range(2003).selectExpr(f"{value} AS x").union(spark.sql("SELECT CAST(NULL AS DOUBLE)"))
    data = [r[0] for r in df.collect() if r[0] is not None]
    probs = [0, 0.01, 1 / 3, 0.5, 2 / 3, 0.977, 1]
    assert quantiles.exact_quantiles(df, "x", probs) == pytest.approx(list(np.quantile(data, probs)), rel=1e-12)


@pytest.mark.parametrize("data", [[1.0, 2.0, 4.0], [3.0, 3.0], [5.0], [1.0, 1.0, 1.0, 7.0]])
def test_quantiles_of_few_values_are_exact(spark, data):
    df = spark.createDataFrame([(x,) for x in data], "x double")
    probs = [0, 0.25, 0.5, 0.9, 1]
    assert quantiles.exact_quantiles(df, "x", probs) == pytest.approx(list(np.quantile(data, probs)), rel=1e-12)


@pytest.mark.parametrize("size", [2000, 2001])
def test_group_median_is_exact(spark, monkeypatch, size):
    groups = "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN NULL ELSE 'tied' END AS g"
    values = "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 3 = 2 THEN double(id % 2) ELSE double(id * 7919 % 2003) END AS x"
    df = spark.range(size).selectExpr(groups, values).union(spark.sql("SELECT 'one', 5.0D UNION ALL SELECT 'none', NULL"))
    want = {r[0]: r[1] for r in df.groupBy("g").agg(F.median("x")).collect() if r[1] is not None}
    assert {r["g"]: r["median"] for r in quantiles.group_median(df, ["g"], "x").collect()} == want


def test_quantile_bins(spark, rows):
    df = spark.createDataFrame([(float(i),) for i in range(1, 8)], "x double")
    out = quantiles.quantile_bins(df, "x", [0, 1 / 3, 2 / 3, 1])
    assert rows(out) == [
        (1.0, None), (2.0, "(1,3]"), (3.0, "(1,3]"), (4.0, "(3,5]"), (5.0, "(3,5]"), (6.0, "(5,7]"), (7.0, "(5,7]"),
    ]


def test_apply_sort_helpers(spark, rows):
    df = spark.createDataFrame([("a", 1, 2.5)], "k string, i int, x double")
    assert rows(cleaning.apply_to(df, lambda c: c * 2)) == [("a", 2, 5.0)]
    assert cleaning.numeric_columns(df) == ["i", "x"]
