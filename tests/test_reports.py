"""Reports in the pass that writes, numbering without collisions, running sums over ranges, ordered categories, remembered totals."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from worktally.functions.names import clean_name_list, normalize_values
from worktally.operators import adorn, ranking, reports, tabulate


@pytest.fixture
def small_ranges(spark):
    """Ranges stay as they are dealt, however small."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


# ---- reports


def test_gate_counts_and_splits(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("b", float("nan")), (None, None)], "k string, `v.x` double")
    gate = reports.quality_report(df, ["k", "v.x"])
    assert gate.counts == {"rows": 4, "rejected": 3, "missing k": 2, "missing v.x": 2}
    assert [r["k"] for r in gate.accepted.collect()] == ["a"] and gate.rejected.count() == 3
    assert gate.accepted.columns == df.columns
    with pytest.raises(reports.RejectedValues) as e:
        reports.quality_report(df, ["k"], strict=True)
    assert e.value.counts["missing k"] == 2
    assert reports.quality_report(df.filter("k = 'a'"), ["k"], strict=True).counts["rejected"] == 0
    assert reports.quality_report(df.filter("k = 'none'"), ["k"]).counts["rows"] == 0


def test_gate_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def look(k):
        seen.add(1)
        return k

    df = spark.range(100).select(look(F.col("id").cast("string")).alias("k"))
    gate = reports.quality_report(df, ["k"])
    assert gate.accepted.count() + gate.rejected.count() == 100 and seen.value == 100


def test_dates_report(spark):
    texts = ["43000", "2020-01-05", "no", None, "60", "0", "-3", "2020/02/01", "5d"]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, i int")
    read = reports.read_dates(df, {"text": "text", "i": "day"})
    assert read.counts["text"] == {"rows": 9, "missing": 1, "unreadable": 2, "not_positive": 2, "no_such_day": 1, "skipped_hour": 0}
    assert read.counts["i"] == {"rows": 9, "missing": 0, "unreadable": 0, "not_positive": 1, "no_such_day": 0, "skipped_hour": 0}
    days = {r["i"]: r["text"] for r in read.table.collect()}
    assert days[0] == dt.date(2017, 9, 22) and days[2] is None and days[7] == dt.date(2020, 2, 1)
    assert read.report().count() == 2
    with pytest.raises(reports.RejectedValues, match="unreadable in text 2, no_such_day in text 1"):
        reports.read_dates(df, {"text": "day"}, strict=True)


def test_skipped_hours_are_counted(spark):
    # 2021-03-28 02:30 does not exist in Berlin.
    df = spark.createDataFrame([(44283 + 2.5 / 24,), (44283 + 4.5 / 24,), (None,)], "serial double")
    read = reports.read_dates(df, {"serial": "moment"}, include_time=True, tz="Europe/Berlin")
    assert read.counts["serial"]["skipped_hour"] == 1 and read.counts["serial"]["unreadable"] == 0
    with pytest.raises(reports.RejectedValues):
        reports.read_dates(df, {"serial": "moment"}, include_time=True, tz="Europe/Berlin", strict=True)


# ---- numbering


@pytest.mark.parametrize("seed", range(3))
def test_numbers_that_are_taken_are_left_out(spark, small_ranges, seed):
    rng = random.Random(seed)
    names = [rng.choice(["a", "a", "a", "b", "A_2", "a 3", "a_2_2", "b_02", "b_1", "", "a_" + "9" * 30, f"a {rng.randint(2, 60)}"]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string").repartition(5)
    got = [r["name"] for r in normalize_values(df, "name", order=["i"]).orderBy("i").collect()]
    assert len(set(got)) == len(got)
    assert got == clean_name_list(names)


def test_one_hot_value_with_taken_numbers(spark):
    df = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("a_"), F.col("id") + 2)).otherwise(F.lit("a")).alias("name"))
    got = normalize_values(df, "name", order=["id"])
    assert got.columns == ["id", "name"]
    n, unique, longest = got.agg(F.count("*"), F.count_distinct("name"), F.max(F.regexp_extract("name", "_([0-9]+)$", 1).try_cast("int"))).first()
    # 2, 5, 8 to 59,999 are taken; 39,999 repeats take 3, 4, 6, 7 to 59,998, and 60,000.
    assert n == unique == longest == 60_000


def test_running_sum_of_one_group(spark, small_ranges):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("id"), F.lit("g").alias("by"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("x")).repartition(7)
    out = ranking.running_sum(df, ["by"], ["id"], "x", "total").orderBy("id").collect()
    total = 0
    for r in out:
        total += r["x"] or 0
        assert r["total"] == total
    pieces = ranking._placed(df, ["by"], ["id"]).groupBy("__piece").count().agg(F.max("count"), F.count("*")).first()
    assert pieces[1] > 1 and pieces[0] < 20_000


# ---- ordered categories


def test_rows_and_columns_in_the_order_of_levels(spark):
    df = spark.createDataFrame([("hi", 3), ("lo", 1), (None, 2), ("mid", None), ("else", 1), ("another", 10), ("lo", 2)], "size string, code int")
    tab = tabulate.tabyl(df, "size", "code", row_levels=["lo", "mid", "hi"], col_levels=[3, 9, 1]).adorn_totals()
    wide = tab.wide()
    assert wide.columns == ["size", "3", "9", "1", "2", "10", "NA_", "Total"]
    assert [r["size"] for r in wide.collect()] == ["lo", "mid", "hi", "another", "else", "NA", "Total"]
    assert [r["size"] for r in tabulate.tabyl_one(df, "size", ["lo", "none", "hi"]).collect()] == ["lo", "none", "hi", "another", "else", "mid", None]
    assert [r["code"] for r in tabulate.tabyl_one(df, "code").collect()] == [1, 2, 3, 10, None]
    assert [r["size"] for r in tab.counts().select("size").distinct().limit(9).collect()]
    assert [(r["size"], r["code"]) for r in tab.counts().collect()][:3] == [("lo", 3), ("lo", 9), ("lo", 1)]


def test_variables_of_any_name(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 4), ("c", 5)], "r string, value int")
    wide = tabulate.tabyl(df, "r", "value").wide()
    assert wide.columns == ["r", "1", "2", "3", "4", "5"]
    assert [tuple(r) for r in wide.collect()] == [("a", 1, 1, 0, 0, 0), ("b", 0, 0, 1, 1, 0), ("c", 0, 0, 0, 0, 1)]
    for name in ("n", "value", "text", "row_total", "col_total", "__row", "a.b", "per`cent"):
        named = df.toDF("r", name)
        tab = tabulate.tabyl(named, "r", name).adorn_totals().adorn_percentages().adorn_pct_formatting().adorn_ns()
        assert [r["Total"] for r in tab.wide().collect()] == ["100.0% (2)", "100.0% (2)", "100.0% (1)", "100.0% (5)"]
        assert tabulate.tabyl_one(named, name).count() == 5
        assert sorted(r[-1] for r in tabulate.tabyl(named, "r", name).counts().collect()) == [1] * 5
    again = tabulate.tabyl_one(tabulate.tabyl_one(df, "r"), "n")
    assert again.columns == ["n", "n_2", "percent", "valid_percent"] and [(r[0], r[1]) for r in again.collect()] == [(1, 1), (2, 2)]


def test_labels_that_are_values(spark):
    df = spark.createDataFrame([("x", "NA_"), ("x", None), ("Total", "Total"), ("NA", ""), (None, "NA__2")], "r string, c string")
    wide = tabulate.tabyl(df, "r", "c").adorn_totals().wide()
    assert wide.columns == ["r", "emptystring_", "NA_", "NA__2", "Total", "NA__3", "Total_2"]
    rows = [tuple(r) for r in wide.collect()]
    assert rows[0] == ("NA", 1, 0, 0, 0, 0, 1) and rows[1] == ("Total", 0, 0, 0, 1, 0, 1) and rows[-1] == ("Total", 1, 1, 1, 1, 1, 5)
    assert rows[2] == ("x", 0, 1, 0, 0, 1, 2) and rows[3] == ("NA", 0, 0, 1, 0, 0, 1)


# ---- remembered totals


def test_totals_stay_out_of_shares_whatever_happens_in_between(spark):
    df = spark.createDataFrame([("a", 1, 3), ("Total", 4, None), ("c", 5, 7)], "k string, x int, y int")
    frame = adorn.adorn_totals(adorn.remembered(df), "row")
    frame = adorn.adorn_totals(frame.orderBy(F.desc("x")), "col", name="Both").filter("k <> 'a'")
    shares = adorn.plain(adorn.adorn_percentages(frame, "row")).collect()
    assert {(r["k"], r["x"], r["Both"]) for r in shares} == {("Total", 0.5, 1.0), ("c", 5 / 12, 1.0), ("Total", 1.0, 1.0)}
    whole = adorn.adorn_totals(adorn.remembered(df), ["row", "col"])
    down = adorn.plain(adorn.adorn_percentages(whole, "col"))
    assert down.columns == ["k", "x", "y", "Total"]
    assert sorted(r["x"] for r in down.collect()) == [0.1, 0.4, 0.5, 1.0]
    noted = adorn.plain(adorn.adorn_ns(adorn.adorn_pct_formatting(adorn.adorn_percentages(whole, "all"), 0)))
    assert {r["Total"] for r in noted.collect()} == {"20% (4)", "20% (4)", "60% (12)", "100% (20)"}
    with pytest.raises(ValueError):
        adorn.adorn_ns(df)
