"""Expanding fits and running medians against fits made one by one in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.operators import expanding as E
from skyledger.operators import models as M


def one_fit(x, y, ridge=0.0):
    """Median fill, centred least squares, absolute residuals on the same design."""
    seen = ~np.isnan(y)
    x, y = x[seen], y[seen]
    medians = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in x.T])
    x = np.where(np.isnan(x), medians, x)

    def fit(t):
        xc, tc = x - x.mean(0), t - t.mean()
        beta = np.linalg.lstsq(xc.T @ xc + ridge * np.eye(x.shape[1]), xc.T @ tc, rcond=None)[0]
        return np.array([t.mean() - x.mean(0) @ beta, *beta])

    mean = fit(y)
    return medians, mean, fit(np.abs(y - mean[0] - x @ mean[1:]))


def frame(spark, x, y, block):
    names = [f"x{i}" for i in range(x.shape[1])]
    none = lambda v: None if np.isnan(v) else float(v)
    rows = [(*map(none, r), none(t), int(b)) for r, t, b in zip(x, y, block, strict=True)]
    return names, spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", y double, block int")


def test_missing_features_in_expanding_fits(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2)) * [1, 5] + [1e5, 0]
    y = 2 * x[:, 0] + 3 * x[:, 1] + 1 + rng.normal(size=400)
    x[rng.random(400) < 0.3, 0] = np.nan
    x[:120, 1] = np.nan  # the first refit has seen no value of the second feature
    y[rng.random(400) < 0.05] = np.nan
    block = np.sort(rng.integers(0, 6, 400))
    block[:100] = 0
    names, df = frame(spark, x, y, block)
    fits = E.expanding_gaussian(df, names, "y", "block", ridge=2.0).table.orderBy("refit").collect()
    assert [r["refit"] for r in fits] == list(range(5))
    for r in fits:
        upto = block <= r["refit"]
        medians, mean, spread = one_fit(x[upto], y[upto], 2.0)
        assert r["medians"] == pytest.approx(list(medians))
        assert r["mean"] == pytest.approx(list(mean), rel=1e-6) and r["spread"] == pytest.approx(list(spread), rel=1e-5, abs=1e-6)


def test_scoring_fills_gaps_with_the_refits_median(spark):
    rows = [(float(i), 2.0 * i + 1, 0 if i < 5 else 1) for i in range(9)] + [(None, 7.0, 1), (float("nan"), 7.0, 1)]
    df = spark.createDataFrame(rows, "x double, y double, block int")
    out = E.expanding_gaussian(df, ["x"], "y", "block").score(df.where("block = 1").withColumn("refit", F.lit(0)))
    got = [(r["x"], r["pred_mean"]) for r in out.collect()]
    assert len(got) == 6 and all(p == pytest.approx(5.0 if x is None or x != x else 2 * x + 1) for x, p in got)


def test_empty_and_untrained_input(spark):
    empty = spark.createDataFrame([], "x double, y double, block int")
    assert E.expanding_gaussian(empty, ["x"], "y", "block").table.count() == 0
    folded = spark.createDataFrame([], "x double, y double, target_date date, market_id string")
    assert M.rolling_backtest(folded, ["x"], "y", ["target_date"], 5).count() == 0
    # no target in the first block, no row in the second
    df = spark.createDataFrame([(1.0, None, 0), (1.0, 2.0, 2), (3.0, 6.0, 2), (5.0, None, 4)], "x double, y double, block int")
    fits = E.expanding_gaussian(df, ["x"], "y", "block")
    assert [(r["refit"], [round(v, 6) for v in r["mean"]]) for r in fits.table.orderBy("refit").collect()] == [(2, [0.0, 2.0]), (3, [0.0, 2.0])]
    scored = fits.score(df.withColumn("refit", F.col("block") - 1)).orderBy("block").collect()
    assert [None if r["pred_mean"] is None else round(r["pred_mean"], 6) for r in scored] == [None, None, None, 10.0]


def test_fits_without_features_are_means(spark):
    df = spark.createDataFrame([(1.0, 0), (3.0, 0), (8.0, 1), (0.0, 2)], "y double, block int")
    got = E.expanding_gaussian(df, [], "y", "block").table.orderBy("refit").collect()
    assert [(r["mean"], r["spread"]) for r in got] == [([2.0], [1.0]), ([4.0], [pytest.approx(8 / 3)])]


@pytest.mark.parametrize("range_rows", [1 << 17, 40])
def test_running_medians_equal_numpy(spark, range_rows):
    rng = np.random.default_rng(3)
    n, refits = 1500, 60
    x = np.column_stack([rng.normal(size=n) ** 3 * 100, np.round(rng.normal(size=n)), np.where(rng.random(n) < 0.7, 5.0, rng.normal(size=n))])
    x[rng.random(x.shape) < 0.2] = np.nan
    block = rng.integers(0, refits + 1, n)
    names, df = frame(spark, x, np.zeros(n), block)
    got = {(r["refit"], r["feature"]): r["median"] for r in E.running_medians(df, names, "block", refits, range_rows).collect()}
    want = {}
    for r in range(refits):
        for f in range(3):
            seen = x[(block <= r) & ~np.isnan(x[:, f]), f]
            if len(seen):
                want[r, f] = float(np.median(seen))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_ten_thousand_refits_have_the_closed_form(spark):
    rng = np.random.default_rng(5)
    n, refits = 20_000, 10_000
    x, block = rng.normal(size=(n, 1)), np.arange(n) * (refits + 1) // n
    y = 3 * x[:, 0] + rng.normal(size=n)
    x[rng.random(n) < 0.1, 0] = np.nan
    names, df = frame(spark, x, y, block)
    fits = {r["refit"]: r for r in E.expanding_gaussian(df, names, "y", "block").table.collect()}
    assert len(fits) == refits
    for r in (3, 50, 511, 512, 4999, 9999):
        medians, mean, spread = one_fit(x[block <= r], y[block <= r])
        assert fits[r]["medians"] == pytest.approx(list(medians))
        assert fits[r]["mean"] == pytest.approx(list(mean), abs=1e-8) and fits[r]["spread"] == pytest.approx(list(spread), abs=1e-8)


def test_kth_smallest_of_weighted_prefixes():
    rng = np.random.default_rng(6)
    values, weights = rng.integers(0, 9, 80).astype(float), rng.integers(1, 5, 80)
    upto = rng.integers(1, 81, 300)
    ranks = np.array([rng.integers(0, weights[:u].sum()) for u in upto])
    want = [np.sort(np.repeat(values[:u], weights[:u]))[k] for u, k in zip(upto, ranks, strict=True)]
    assert list(E.kth_smallest(values, weights, upto, ranks)) == want


def test_a_gap_at_scoring_only_counts_as_the_median(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(101, 2))
    df = spark.createDataFrame([(float(a), float(b), float(1 + 2 * a + 3 * b)) for a, b in x], "a double, b double, y double")
    fit = M.fit_gaussian(df, ["a", "b"], "y")
    assert fit.mean.medians == {"a": pytest.approx(np.median(x[:, 0])), "b": pytest.approx(np.median(x[:, 1]))} == fit.spread.medians
    gap = fit.score(spark.createDataFrame([(None, 1.0), (float("nan"), 1.0)], "a double, b double")).collect()
    assert [r["pred_mean"] for r in gap] == pytest.approx([1 + 2 * np.median(x[:, 0]) + 3] * 2) and all(r["pred_std"] == 0.5 for r in gap)


def test_log_variance_without_features_is_the_root_mean_square(spark):
    df = spark.createDataFrame([(0.0,), (4.0,), (5.0,), (None,)], "y double")
    r = M.fit_gaussian(df, [], "y", log_variance=True).score(df).first()
    assert (r["pred_mean"], r["pred_std"]) == (pytest.approx(3.0), pytest.approx(np.sqrt(14 / 3)))
