"""Operators whose groups, axes and keys may be of any size, against plain Python."""

import datetime as dt
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from worktally.operators import cleaning, joins, quantiles, reshape
from worktally.operators.fill import carry_forward, fill_down
from worktally.plans.charges import prepare_projects

DAY = dt.date(2024, 1, 1)
DATES = "date date", "startdate date, enddate date"


def key(row):
    return [(v is None, str(v)) for v in row]


@pytest.mark.parametrize("limit", [10, 300, 1_000_000])
def test_group_quantiles_narrow_to_the_limit(spark, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "SORT_LIMIT", limit)
    monkeypatch.setattr(quantiles, "CUTS", 8)
    held = []
    narrowed = quantiles._narrowed

    def watched(*args):
        out = narrowed(*args)
        held.append(out.agg(F.max("__held")).first()[0])
        return out

    monkeypatch.setattr(quantiles, "_narrowed", watched)
    df = spark.range(12_000).selectExpr(
        "CASE WHEN id % 10 < 7 THEN 'hot' WHEN id % 10 = 7 THEN NULL WHEN id % 10 = 8 THEN 'tied' ELSE concat('small', id % 70) END AS g",
        "CASE WHEN id % 13 = 0 THEN NULL WHEN id % 13 = 1 THEN double('NaN') WHEN id % 10 = 8 THEN id % 3 WHEN id % 5 = 0 THEN exp(id % 600) "
        "ELSE -double(id * 7919 % 20011) END AS x",
    )
    probs = {"low": 0.0, "a": 0.013, "b": 1 / 3, "mid": 0.5, "c": 0.977, "high": 1.0}
    values = {}
    for r in df.collect():
        if r["x"] is not None and not np.isnan(r["x"]):
            values.setdefault(r["g"], []).append(r["x"])
    got = {r["g"]: list(r)[1:] for r in quantiles.group_quantiles(df, ["g"], "x", probs).collect()}
    assert set(got) == set(values)
    for g, found in got.items():
        assert found == pytest.approx(list(np.quantile(values[g], list(probs.values()))), rel=1e-9)
    assert len(held) == (limit < 5_000) and all(h <= limit for h in held)


def test_group_quantiles_of_infinite_and_no_values(spark):
    df = spark.sql("SELECT double('Infinity') AS x UNION ALL SELECT double('-Infinity') UNION ALL SELECT 1.0D UNION ALL SELECT NULL")
    assert list(quantiles.group_quantiles(df, [], "x", {"lo": 0, "mid": 0.5, "hi": 1}).first()) == [-np.inf, 1.0, np.inf]
    assert quantiles.group_quantiles(df.limit(0), [], "x", {"mid": 0.5}).collect() == []
    assert quantiles.group_quantiles(df.filter("x IS NULL"), [], "x", {"mid": 0.5}).collect() == []


def test_binned_join_equals_the_plain_one(spark, rows):
    days = spark.range(4_000).selectExpr(
        "nullif(id % 4, 3) AS k", "CASE WHEN id % 50 <> 0 THEN date_add(DATE'1969-11-20', int(id * 37 % 5000)) END AS date", "id % 900 AS i"
    )
    ranges = spark.range(120).selectExpr("nullif(id % 4, 3) AS k", "date_add(DATE'1969-10-01', int(id * 61 % 5000)) AS startdate", "id AS r").selectExpr(
        "k", "startdate", "CASE r % 6 WHEN 0 THEN startdate WHEN 1 THEN date_add(startdate, 31) WHEN 2 THEN date_add(startdate, 2100) "
        "WHEN 3 THEN date_add(startdate, -1) WHEN 4 THEN DATE'9999-12-31' END AS enddate", "r"
    )
    names = ["k", "date", "i", "r"]
    want = rows(joins.validity_join(days, ranges, ["k"]), *names)
    assert want and rows(joins.binned_validity_join(days, ranges, ["k"]), *names) == want
    assert rows(joins.binned_validity_join(days, ranges.limit(0), ["k"])) == []
    assert rows(joins.binned_validity_join(days.limit(0), ranges, ["k"])) == []
    with pytest.raises(TypeError):
        joins.binned_validity_join(days.withColumn("date", F.col("date").cast("timestamp")), ranges, ["k"])


@pytest.mark.parametrize("pairs", [0, 1_000, 20_000, 1_000_000])
def test_binned_join_of_few_and_of_crowded_keys(spark, rows, monkeypatch, pairs):
    monkeypatch.setattr(joins, "PAIRS", pairs)
    days = spark.range(3_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 30 <> 1 THEN concat('k', id % 70) END AS k", "date_add(DATE'1969-06-20', int(id * 37 % 900)) AS date", "id AS i"
    )
    ranges = spark.range(500).selectExpr(
        "CASE WHEN id % 4 = 0 THEN 'hot' WHEN id % 30 <> 1 THEN concat('k', id % 90) END AS k", "date_add(DATE'1969-06-01', int(id * 61 % 900)) AS startdate", "id AS r"
    ).selectExpr("k", "startdate", "date_add(startdate, int(CASE r % 50 WHEN 7 THEN 60000 WHEN 8 THEN -1 ELSE r * 7 % 400 END)) AS enddate", "r")
    names = ["k", "date", "i", "startdate", "enddate", "r"]
    want = rows(joins.validity_join(days, ranges, ["k"]), *names)
    assert want and rows(joins.binned_validity_join(days, ranges, ["k"]), *names) == want


def test_binned_join_sends_few_rows_for_a_range_of_a_key_with_few(spark):
    """A range of up to 400 days met its key as about 17 rows, whatever the key held."""
    days = spark.range(2_000).selectExpr("id % 500 AS k", "date_add(DATE'2000-01-01', int(id * 37 % 2400)) AS date")
    ranges = days.selectExpr("k", "date AS startdate", "date_add(date, int(k % 400)) AS enddate")
    want = joins.validity_join(days, ranges, ["k"]).count()
    spread = []
    joined = joins.join_null_safe

    def watched(left, right, *args):
        spread.append((left.count(), right.count()))
        return joined(left, right, *args)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(joins, "join_null_safe", watched)
        assert joins.binned_validity_join(days, ranges, ["k"]).count() == want
    assert len(spread) == 1 and spread[0][0] == 2_000 and spread[0][1] <= 2 * 2_000


def test_binned_join_needs_no_key_and_tests_no_range(spark, rows):
    days = spark.range(300).selectExpr("date_add(DATE'2000-01-01', int(id)) AS date")
    ranges = spark.range(2_000).selectExpr("date_add(DATE'2000-01-01', int(id * 7 % 290)) AS startdate", "int(id % 40) AS n").selectExpr(
        "startdate", "date_add(startdate, n) AS enddate"
    )
    out = joins.binned_validity_join(days, ranges, [])
    held = [(r.startdate, r.enddate) for r in ranges.collect()]
    assert out.count() == sum(a <= r.date <= b for r in days.collect() for a, b in held)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    condition = next(line for line in plan.splitlines() if "Join" in line)
    assert "startdate" not in condition and "enddate" not in condition


def test_blocks_hold_each_day_once(spark):
    spans = [(a, a + n) for a in (-70_001, -33, -1, 0, 5, 31, 32, 1_023) for n in (0, 1, 30, 31, 32, 63, 64, 1_100, 40_000)]
    df = spark.createDataFrame(spans, "a long, b long").select("a", "b", joins._blocks(F.col("a"), F.col("b")).alias("blocks"))
    for a, b, blocks in df.collect():
        days = sorted(d for x in blocks for d in range(x.number * joins.BLOCK**x.level, (x.number + 1) * joins.BLOCK**x.level))
        assert days == list(range(a, b + 1)) and len(blocks) <= 14 * 5 + 2


def test_coarse_blocks_hold_whole_blocks_once(spark):
    spans = [(a, a + n) for a in (-70_001, -33, 0, 511, 512, 1_023) for n in (0, 1, 511, 512, 4_500, 40_000)]
    df = spark.createDataFrame(spans, "a long, b long").select("a", "b", joins._blocks(F.col("a"), F.col("b"), 3).alias("blocks"))
    for a, b, blocks in df.collect():
        size = {x: joins.BLOCK ** (x.level - 3) for x in blocks}
        assert sorted(n for x in blocks for n in range(x.number * size[x], (x.number + 1) * size[x])) == list(range(a // 512, b // 512 + 1))


@pytest.mark.parametrize("partitions", ["1", "16"])
def test_carry_forward_through_one_large_group(spark, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(3_000).selectExpr(
            "id AS i", "CASE WHEN id % 20 < 17 THEN 'hot' WHEN id % 20 = 17 THEN NULL ELSE 'cold' END AS g",
            "timestamp_micros(id * 7919 % 3001) AS at", "CASE WHEN id % 400 = 6 THEN concat('v', id) END AS v",
        )
        got = {r["i"]: r["v"] for r in carry_forward(df, "v", ["g"], ["at"]).collect()}
        last, want = {}, {}
        for r in sorted(df.collect(), key=lambda r: r["at"]):
            last[r["g"]] = r["v"] or last.get(r["g"])
            want[r["i"]] = last[r["g"]]
        assert got == want and len(set(want.values())) > 5
        assert {r["i"]: r["v"] for r in fill_down(df, "v", ["g"], "at").collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_carry_forward_ties_missing_order_and_empty(spark, rows):
    df = spark.createDataFrame([(1, None), (1, 5), (1, 3), (2, None), (None, None), (None, 9)], "at int, v int")
    assert rows(carry_forward(df, "v", [], ["at"])) == [(1, 3), (1, 5), (1, 5), (2, 5), (None, 9), (None, 9)]
    assert rows(carry_forward(df.limit(0), "v", [], ["at"])) == []


def test_complete_keys(spark, rows):
    data = [("a", 1, DAY, 2.0), ("a", 1, DAY, 2.0), ("b", None, DAY, None), (None, 3, DAY + dt.timedelta(1), 4.0)]
    df = spark.createDataFrame(data, "k string, n int, d date, v double")
    axes = [{r[i] for r in data} for i in range(3)]
    absent = set(product(*axes)) - {r[:3] for r in data}
    want = sorted([*data, *[(*c, None) for c in absent]], key=key)
    assert sorted((tuple(r) for r in reshape.complete_keys(df, ["k", "n", "d"]).collect()), key=key) == want
    filled = reshape.complete_keys(df, ["k", "n", "d"], {"v": 0.0})
    assert filled.filter("v = 0").count() == len(absent) + 1 and filled.columns == df.columns
    assert rows(reshape.complete_keys(df.limit(0), ["k", "n", "d"])) == []


def test_complete_keys_with_a_large_axis(spark):
    df = spark.range(5_000).selectExpr("id AS big", "id % 3 AS x", "id % 2 AS y", "id % 2 AS z")
    out = reshape.complete_keys(df, ["big", "x", "y", "z"])
    assert out.count() == out.distinct().count() == 5_000 * 12
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def test_fill_with_max_by(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 4), (None, None), ("b", None)], "g string, x int")
    assert rows(cleaning.fill_with_max(df, "x", ["g"])) == [("a", 1), ("a", 1), ("b", None), (None, 4), (None, 4)]


def test_prepare_projects_by(spark):
    plan = spark.createDataFrame(
        [("p", "2026", "2026-01-05", "2026-03-01"), ("p", "2026", "2026-01-05", None), ("q", "2026", "2026-01-05", "2026-09-01"), ("q", "2026", "2026-02-02", None)],
        "person string, year string, startdate string, enddate string",
    ).withColumns({"subcode": F.lit(None).cast("string"), "budgeted": F.lit("1")})
    ends = {(r["person"], str(r["enddate"])) for r in prepare_projects(plan, by=["person"]).collect()}
    assert ends == {("p", "2026-03-01"), ("q", "2026-09-01")}
