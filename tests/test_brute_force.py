"""Operators against plain Python on small random data, and models without SQL."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from skyledger.operators import asof, bins as B, folds, models as M, quantiles, trade as X, windows as W


def test_asof_never_looks_ahead_and_finds_the_latest(spark):
    rng = random.Random(7)
    base = dt.datetime(2025, 1, 1)
    ticks = [(rng.choice("abc"), base + dt.timedelta(minutes=rng.randint(0, 9000)), round(rng.random(), 3), i) for i in range(400)]
    decisions = [(rng.choice("abcd"), i, base + dt.timedelta(minutes=rng.randint(-50, 9500))) for i in range(300)]
    t = spark.createDataFrame(ticks, "k string, at timestamp, price double, seq long")
    d = spark.createDataFrame(decisions, "k string, id long, decided timestamp")
    got = {r["id"]: (r["price"], r["matched_time"]) for r in asof.asof_join(d, t, ["k"], "decided", "at", ["price"], "seq", 7200).collect()}
    for k, i, when in decisions:
        prior = [x for x in ticks if x[0] == k and x[1] <= when]
        want = max(prior, key=lambda x: (x[1], x[3])) if prior else None
        assert got[i] == ((want[2], want[1]) if want else (None, None))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.floats(-1e6, 1e6).map(lambda v: round(v, 3)))), min_size=1, max_size=40))
def test_quantiles_match_numpy(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["p"], r["q"]) for r in quantiles.grouped_quantiles(df, ["k"], "v", {"p": 0.5, "q": 0.9}).collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    got = {k: v for k, v in got.items() if v != (None, None)}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k] == pytest.approx((np.quantile(vs, 0.5), np.quantile(vs, 0.9)), rel=1e-9, abs=1e-9)


def test_one_hot_key_spans_many_slices(spark):
    rows = [("hot", dt.datetime(2025, 1, 1) + dt.timedelta(minutes=7 * i), float(i % 17)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, at timestamp, v double")
    out = asof.running_max(df, ["k"], "at", "v", "peak", slice_seconds=3600).orderBy("at").collect()
    peak = 0.0
    for r in out:
        peak = max(peak, r["v"])
        assert r["peak"] == peak
    prev = W.with_previous(df, ["k"], "at", "v", "prev", slice_seconds=3600).orderBy("at").collect()
    assert [r["prev"] for r in prev] == [None, *[r["v"] for r in prev[:-1]]]


def pav(points):
    blocks = []
    for x, w, m in points:
        blocks.append([x, x, w, m])
        while len(blocks) > 1 and blocks[-2][3] >= blocks[-1][3]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([a[0], b[1], a[2] + b[2], (a[2] * a[3] + b[2] * b[3]) / (a[2] + b[2])])
    return blocks


def test_isotonic_equals_pooling_at_once(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(600), 3)
    y = (rng.random(600) < p).astype(float)
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(p, y)] + [("few", 0.5, 1.0)], "label string, p double, y double")
    blocks = M.fit_isotonic(df, "label", "p", "y")
    got = sorted((r["x_low"], r["x_high"], r["mean"]) for r in blocks.collect() if r["label"] == "a")
    xs = sorted(set(p))
    want = pav([(x, float((p == x).sum()), float(y[p == x].mean())) for x in xs])
    assert np.allclose(np.array(got), np.array([[b[0], b[1], b[3]] for b in want]))

    grid = np.linspace(-0.1, 1.1, 97)
    q = spark.createDataFrame([("a", float(g)) for g in grid] + [("new", 0.3)], "label string, p double")
    applied = {(r["label"], round(r["p"], 9)): r["calibrated"] for r in M.apply_isotonic(q, blocks, "label", "p").collect()}
    knots_x = [v for b in want for v in (b[0], b[1])]
    knots_y = [v for b in want for v in (b[3], b[3])]
    for g in grid:
        assert applied[("a", round(float(g), 9))] == pytest.approx(np.interp(g, knots_x, knots_y), abs=1e-9)
    assert applied[("new", 0.3)] == 0.3


def test_linear_fit_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) * [1, 10, 0.1] + [0, 5, 2]
    y = 3 + x @ [1.5, -0.2, 4.0] + rng.normal(size=300)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    fit = M.fit_linear(df, ["a", "b", "c"], "y")
    want = np.linalg.lstsq(np.column_stack([np.ones(300), x]), y, rcond=None)[0]
    assert [fit.intercept, *fit.coefficients] == pytest.approx(want, rel=1e-8)
    ridge = M.fit_linear(df, ["a", "b", "c"], "y", ridge=7.0)
    xc, yc = x - x.mean(0), y - y.mean()
    coef = np.linalg.solve(xc.T @ xc + 7.0 * np.eye(3), xc.T @ yc)
    assert ridge.coefficients == pytest.approx(coef, rel=1e-8)


def test_expanding_fits_equal_single_fits(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(v), float(2 * v + rng.normal()), int(folds_block(i))) for i, v in enumerate(rng.normal(size=400))]
    df = spark.createDataFrame(rows, "i int, x double, y double, block int")
    fits = M.expanding_gaussian(df, ["x"], "y", "block").table.orderBy("refit").collect()
    assert len(fits) == 3
    for r in fits:
        single = M.fit_gaussian(df.where(F.col("block") <= r["refit"]), ["x"], "y")
        assert r["mean"] == pytest.approx([single.mean.intercept, *single.mean.coefficients], rel=1e-8)
        assert r["spread"] == pytest.approx([single.spread.intercept, *single.spread.coefficients], rel=1e-7)


def folds_block(i):
    return 0 if i < 100 else (i - 100) // 100 + 1


def test_folds_never_train_on_the_future(spark):
    rng = random.Random(1)
    rows = [(f"m{rng.randint(0, 30)}", dt.date(2025, 1, rng.randint(1, 28)), float(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "market_id string, target_date date, v double")
    folded = folds.expanding_folds(df, ["market_id", "target_date"], 20, 30).collect()
    for k in {r["fold"] for r in folded if r["fold"] is not None}:
        test = [r for r in folded if r["fold"] == k]
        train = [r for r in folded if r["ordinal"] < 20 + 30 * k]
        assert max(r["target_date"] for r in train) <= min(r["target_date"] for r in test)
        assert not {(r["market_id"], r["target_date"]) for r in train} & {(r["market_id"], r["target_date"]) for r in test}


def test_ordinals_are_a_permutation(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["2025-01-01"] * 9 + ["2025-01-02"]), i) for i in rng.sample(range(1000), 400)]
    df = spark.createDataFrame(rows, "d string, i int")
    got = [(r["d"], r["i"]) for r in folds.global_ordinal(df, ["d", "i"]).orderBy("ordinal").collect()]
    assert got == sorted(rows)


def test_stop_scan_matches_a_loop(spark):
    rng = random.Random(4)
    rows = []
    for p in range(20):
        price = 0.5
        for i in range(60):
            price = max(0.01, price + rng.uniform(-0.06, 0.06))
            rows.append((f"p{p}", dt.datetime(2025, 1, 1) + dt.timedelta(hours=i), i, round(price, 4), 0.5))
    df = spark.createDataFrame(rows, "p string, at timestamp, seq long, price double, entry double")
    got = {r["p"]: (r["exit_time"], r["exit_reason"]) for r in asof.stop_scan(df, ["p"], "at", "price", "entry", 0.2, ["seq"], 7200).collect()}
    want = {}
    for p in {r[0] for r in rows}:
        peak = 0.5
        for r in (x for x in rows if x[0] == p):
            peak = max(peak, r[3])
            if (0.5 - r[3]) / 0.5 >= 0.2:
                want[p] = (r[1], "stop_loss")
            elif peak > 0.5 and (peak - r[3]) / peak >= 0.2:
                want[p] = (r[1], "trailing_stop")
            if p in want:
                break
    assert got == want


def test_best_trade_takes_the_first_of_equal_edges(spark):
    rows = [(1, 0, "a", 0.5, 0.3, 0.3, "ok"), (1, 1, "b", 0.5, 0.3, 0.3, "ok"), (2, 0, "a", 0.5, 0.3, 0.3, "stale"), (3, 0, "a", 0.1, 0.3, 0.3, "ok"), (4, 0, "a", 0.9, None, None, "missing")]
    df = spark.createDataFrame(rows, "id int, ordinal int, outcome_label string, fair_probability double, market_price double, executable_price double, coverage_status string")
    got = {r["id"]: (r["outcome"], r["outcome_label"]) for r in X.best_trades(df, ["id"], ["ordinal"]).collect()}
    assert got == {1: ("traded", "a"), 2: ("stale_price", None), 3: ("non_positive_edge", None), 4: ("missing_price", None)}


def test_range_join_takes_the_first_bin(spark):
    bins = spark.createDataFrame([("m", 0, "lo", None, 5.0), ("m", 1, "mid", 5.0, 9.0), ("m", 2, "hi", 10.0, None)], "m string, ordinal int, label string, lower double, upper double")
    vals = spark.createDataFrame([("m", 1, 5.2), ("m", 2, 9.5), ("m", 3, 4.0), ("n", 4, 4.0), ("m", 5, 5.2), ("m", 6, None)], "m string, id int, v double")
    got = {r["id"]: r["winning_label"] for r in B.range_join_bins(vals, bins, ["m"], "v").collect()}
    assert got == {1: "lo", 2: "hi", 3: "lo", 4: None, 5: "lo", 6: None}


def test_polynomial_fits_match_numpy_plain_and_scaled(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(200, 2)) * [3, 0.5] + [10, 1]
    y = 1 + x[:, 0] - 2 * x[:, 1] + 0.3 * x[:, 0] * x[:, 1] + rng.normal(size=200)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "i int, a double, b double, y double")
    design = np.column_stack([np.ones(200), x, x[:, 0] ** 2, x[:, 0] * x[:, 1], x[:, 1] ** 2])
    want = design @ np.linalg.lstsq(design, y, rcond=None)[0]
    for scale in (False, True):
        wide, fit = M.fit_polynomial(df, ["a", "b"], "y", scale)
        got = [r["pred_mean"] for r in fit.score(wide).orderBy("i").collect()]
        assert got == pytest.approx(list(want), rel=1e-7)
