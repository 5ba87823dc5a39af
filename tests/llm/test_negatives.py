"""Hard negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from worktally.llm import negatives
from worktally.llm.vectors import whole_numbers


def brute(rows, scale=256):
    rows = [(i, lab, [int(np.floor(scale * float(x))) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, lab, v in rows:
        if i % 100:
            continue
        score = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in rows if j != i and len(w) == len(v)]
        for p, pid, _ in sorted(s for s in score if s[2] == lab)[:5]:
            p = -p
            fit = sorted((s, j) for s, j, other in score if other != lab and 80 * p <= -100 * s <= 100 * p)[:5]
            out += [(i, pid, rank + 1, j, p, -s) for rank, (s, j) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"score": F.lit("clash"), "nth": F.lit(1), "a.b": F.lit(2)})
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, F.col("label"), **more)
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("each", [37, negatives.ROWS_PER_BLOCK])
def test_against_brute_force(spark, each):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.4, (600, 6)).round(1)
    x[200:260] = x[100]
    x[300:320] = 0
    label = np.where(rng.random(600) < 0.35, 1, rng.integers(0, 6, 600))
    rows = [(i, int(label[i]), v.tolist()) for i, v in enumerate(x)]
    rows += [(700, 1, None), (800, 1, []), (900, 1, [None] * 6), (1000, 2, [float("nan")] * 6), (1100, 2, [float("inf")] * 6), (1200, None, [1.0] * 6), (None, 1, [0.3] * 6)]
    rows += [(1300, 1, [1.0, 2.0]), (1301, 1, [1.0, 2.0]), (1302, 2, [1.0, 1.9]), (500, 3, [0.5] * 6), (7, 0, [0.2] * 6), (7, 0, [0.2] * 6)]
    want = brute(rows)
    assert len(want) > 50 and mined(spark, rows, rows_per_block=each) == want


def test_components_of_any_size(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, (rng.normal(0, 1, 4) * 10.0 ** rng.integers(0, 7)).tolist()) for i in range(150)]
    assert mined(spark, rows) == brute(rows)
    block = negatives.Block(np.arange(3), np.zeros(3, int), whole_numbers([[1e300, 1.0], [2.0, 3.0], [-5.0, 1e17]], 256), np.zeros((2, 3), int))
    values, anchors = block.fitted(np.array([[256, 512]], np.int64))
    assert (values @ anchors[0]).tolist() == [int(1e300) * 65536 + 256 * 512, 512 * 256 + 768 * 512, -1280 * 256 + int(1e17) * 256 * 512]


def test_reading_stops_early_and_misses_nothing():
    rng = np.random.default_rng(5)
    values = rng.integers(-300, 300, (4000, 3)).astype(float)
    orders = np.argsort(values, axis=0, kind="stable").T
    for _ in range(20):
        anchor = rng.integers(-200, 200, 3).astype(float)
        wanted = rng.random(4000) < 0.5
        seen, scores = negatives.read_until(values, orders, anchor, wanted, lambda s: negatives.kth(s, 5) if len(s) >= 5 else negatives.NOTHING)
        assert len(seen) < wanted.sum() / 2
        assert sorted(scores)[-5:] == sorted(values[wanted] @ anchor)[-5:]


def test_empty_and_single(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, 1, [1.0]), (101, 1, [2.0])]) == []
