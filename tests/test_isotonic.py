"""Isotonic blocks against pooling one after another and the max-min form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.operators import isotonic as I


def pav(points):
    blocks = []
    for x, w, t in points:
        blocks.append([x, x, w, t])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([a[0], b[1], a[2] + b[2], a[3] + b[3]])
    return [(a, b, w, t / w) for a, b, w, t in blocks]


def shapes(rng, n):
    x = np.arange(n) / n
    yield x, rng.integers(1, 9, n), lambda w: rng.binomial(w, x)
    yield x, np.full(n, n), lambda w: np.arange(n)  # rising already: every point is a block
    yield x, np.full(n, n), lambda w: np.arange(n)[::-1]  # one block
    yield x, np.full(n, 100), lambda w: np.arange(n) % 97  # saw teeth


@pytest.mark.parametrize("part_blocks", [1 << 17, 16])
def test_blocks_equal_pooling_one_after_another(spark, part_blocks):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for i, (x, w, hits) in enumerate(shapes(rng, 600)):
        points = list(zip(x.tolist(), w.tolist(), hits(w).tolist(), strict=True))
        rows += [(f"s{i}", *p) for p in points]
        want[f"s{i}"] = pav(points)
    points = spark.createDataFrame(rows, "label string, x double, weight long, total long")
    got = {}
    for r in I.isotonic_blocks(points, part_blocks).orderBy("label", "x_low").collect():
        got.setdefault(r["label"], []).append((r["x_low"], r["x_high"], r["weight"], r["mean"]))
    assert got.keys() == want.keys()
    for k in want:
        assert np.allclose(np.array(got[k]), np.array(want[k])), k


def test_pool_in_runs_equals_one_after_another():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        w, t = rng.integers(1, 5, n).astype(float), rng.integers(0, 5, n).astype(float)
        x = np.arange(n, dtype=float)
        got = np.column_stack(I.pool(x, x, w, t))
        assert np.allclose(got, [(a, b, v, m * v) for a, b, v, m in pav(zip(x, w, t, strict=True))])
    # a cascade that falls back one block at a time
    n = 400
    x, w = np.arange(n + 1, dtype=float), np.ones(n + 1)
    t = np.concatenate((np.arange(n, dtype=float), [-1e6]))
    assert len(I.pool(x, x, w, t)[0]) == 1


def test_a_rising_label_is_cut_over_tasks(spark):
    n = 200_000
    points = spark.range(n).select(F.lit("a").alias("label"), (F.col("id") / n).alias("x"), F.lit(n).alias("weight"), F.col("id").alias("total"))
    spread = I.isotonic_blocks(points, 1 << 14)
    merge = "spark.sql.adaptive.coalescePartitions.enabled"  # small partitions would be read by one task here
    before = spark.conf.get(merge)
    spark.conf.set(merge, "false")
    try:
        sizes = [r["n"] for r in spread.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set(merge, before)
    assert sum(sizes) == n and len(sizes) >= 4 and max(sizes) < n / 2


def test_the_whole_fit_needs_ten_decisions_and_two_winners(spark):
    def blocks(rows, **more):
        df = spark.createDataFrame(rows, "d long, label string, p double, hit boolean")
        return {r["label"] for r in I.fit_isotonic(df, "label", "p", "hit", ["d"], **more).collect()}

    both = [(i, k, 0.5, (i % 2 == 0) == (k == "a")) for i in range(10) for k in "ab"]
    assert blocks(both) == {"a", "b"}
    assert blocks(both[:-2]) == set()  # nine decisions
    assert blocks([(i, k, 0.5, k == "a") for i in range(20) for k in "ab"]) == set()  # one winner
    assert blocks(both + [(99, "rare", 0.9, True)]) == {"a", "b", "rare"}  # the rule is for the fit, not for a label
    assert blocks([]) == set()


def test_a_label_that_is_not_offered_counts_as_zero(spark):
    rows = [(i, "a", 0.4, i % 2 == 0) for i in range(20)] + [(i, "b", 0.0, True) for i in range(4)] + [(4, "b", None, True)]
    df = spark.createDataFrame(rows, "d long, label string, p double, hit boolean")
    got = {r["label"]: (r["weight"], r["mean"]) for r in I.fit_isotonic(df, "label", "p", "hit", ["d"]).collect()}
    assert got == {"a": (20.0, 0.5), "b": (20.0, 0.2)}
