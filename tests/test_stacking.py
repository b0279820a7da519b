"""Stacked experts against ridge fits made fold by fold in numpy."""

import datetime as dt

import numpy as np
import pytest

from skyledger.operators import expanding as E
from skyledger.operators import stacking as S


def ridge(x, y, w, alpha):
    """Weighted ridge, free intercept: (intercept, coefficients)."""
    mx, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    xc = (x - mx) * w[:, None]
    beta = np.linalg.solve(xc.T @ (x - mx) + alpha * np.eye(x.shape[1]), xc.T @ (y - my))
    return my - mx @ beta, beta


def lead_terms(x, train):
    """Second-degree terms of inputs standardized by the training rows."""
    u = (x - x[train].mean(0)) / x[train].std(0)
    return np.column_stack([u, *[u[:, i] * u[:, j] for i in range(u.shape[1]) for j in range(i, u.shape[1])]])


def data(n=240, seed=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [2, 30] + [15, 100]
    return x, 1.5 * x[:, 0] + 0.02 * x[:, 1] + 0.1 * x[:, 0] ** 2 + rng.normal(size=n), rng.uniform(0.2, 1.0, n)


def frame(spark, x, y, w):
    rows = [(i, f"m{i % 7}", dt.date(2025, 1, 1) + dt.timedelta(days=i // 4), *map(float, r), float(t), float(v)) for i, (r, t, v) in enumerate(zip(x, y, w, strict=True))]
    return spark.createDataFrame(rows, "i int, market_id string, target_date date, a double, b double, y double, w double")


def test_ridge_stacker_equals_fits_made_fold_by_fold(spark):
    x, y, w = data()
    out = S.stacked_gaussian(frame(spark, x, y, w), ["a", "b"], ["a", "b"], "y", ["target_date"], 2.0, n_splits=2, experts=("blend", "leadtime"), combiner="linear_stacker", weight="w")
    got = out.orderBy("i").collect()
    day, size = np.arange(240) // 4, 20  # 60 days, parts of 20: folds start at days 20 and 40
    clip = lambda v: np.clip(v, 0.25, 12.0)

    def experts(train):
        means, scales = [], []
        for design in (x, lead_terms(x, train)):
            a, b = ridge(design[train], y[train], w[train], 2.0)
            means.append(a + design @ b)
            a, b = ridge(x[train], clip(np.abs(y - means[-1]))[train], w[train], 2.0)
            scales.append(clip(a + x @ b))
        return np.column_stack(means), np.column_stack(scales)

    valid = day >= size
    oof = np.where((day < 2 * size)[:, None], experts(day < size)[0], experts(day < 2 * size)[0])[valid]
    a, b = ridge(oof, y[valid], w[valid], 2.0)
    c, d = ridge(x[valid], clip(np.abs(y[valid] - a - oof @ b)), w[valid], 2.0)
    means, scales = experts(np.ones(240, bool))
    assert [r["mean_blend"] for r in got] == pytest.approx(list(means[:, 0])) and [r["mean_leadtime"] for r in got] == pytest.approx(list(means[:, 1]))
    assert [r["scale_blend"] for r in got] == pytest.approx(list(scales[:, 0])) and [r["scale_leadtime"] for r in got] == pytest.approx(list(scales[:, 1]))
    assert [r["pred_mean"] for r in got] == pytest.approx(list(a + means @ b)) and [r["pred_std"] for r in got] == pytest.approx(list(clip(c + x @ d)))


def test_gate_gives_weights_and_a_mixture(spark):
    x, y, w = data()
    out = S.stacked_gaussian(frame(spark, x, y, w), ["a", "b"], ["a"], "y", ["target_date"], max_iter=2, n_splits=2).collect()
    assert len(out) == 240
    for r in out:
        g, m, s = ([r[f"{kind}_{e}"] for e in S.EXPERTS] for kind in ("weight", "mean", "scale"))
        assert sum(g) == pytest.approx(1.0)
        assert r["pred_mean"] == pytest.approx(float(np.dot(g, m)))
        assert r["pred_std"] == pytest.approx(max(np.dot(g, np.square(s) + np.square(m)) - r["pred_mean"] ** 2, 0.0625) ** 0.5)
    assert np.mean([abs(r["y"] - r["pred_mean"]) for r in out]) < 3


def test_average_of_one_expert_with_a_constant_gate(spark):
    x, y, w = data(80)
    df = frame(spark, x, y, w)
    for combiner in ("fixed_average", "classifier_gate"):
        out = S.stacked_gaussian(df, ["a"], ["a"], "y", ["target_date"], experts=("blend",), combiner=combiner, n_splits=1).collect()
        assert all(r["pred_mean"] == pytest.approx(r["mean_blend"]) for r in out)


def test_few_rows_or_no_features_give_a_constant(spark):
    x, y, w = data(39)
    for features, n in ((["a"], 39), ([], 39), (["a"], 0)):
        df = frame(spark, x[:n], y[:n], w[:n])
        out = S.stacked_gaussian(df, features, features, "y", ["target_date"]).collect()
        assert len(out) == n
        assert all(r["pred_mean"] == pytest.approx(y.mean()) and r["pred_std"] == pytest.approx(max(y.std(), 0.5)) and r["mean_tree"] is None for r in out)


def test_weighted_clipped_expanding_fits(spark):
    x, y, w = data(200, 3)
    block = np.arange(200) // 50
    rows = [(*map(float, r), float(t), float(v), int(b)) for r, t, v, b in zip(x, y, w, block, strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, y double, w double, block int")
    fits = E.expanding_gaussian(df, ["a", "b"], "y", "block", 0.5, "w", (0.25, 3.0), spread_on=["b"], whole=True).table.orderBy("refit").collect()
    assert [r["refit"] for r in fits] == [0, 1, 2, 3]
    for r in fits:
        t = block <= r["refit"]
        a, b = ridge(x[t], y[t], w[t], 0.5)
        c, d = ridge(x[t, 1:], np.clip(np.abs(y[t] - a - x[t] @ b), 0.25, 3.0), w[t], 0.5)
        assert r["mean"] == pytest.approx([a, *b]) and r["spread"] == pytest.approx([c, 0.0, *d])


def test_few_refits_meet_the_rows_where_they_lie(spark, monkeypatch):
    x, y, w = data(200, 4)
    rows = [(*map(float, r), float(t), float(v), i // 40) for i, (r, t, v) in enumerate(zip(x, y, w, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, y double, w double, block int").repartition(6)
    sums = E.residual_sums
    plans, found = [], []

    def noted(*args):
        out = sums(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(E, "residual_sums", noted)
    for refits in (512, 2):
        monkeypatch.setattr(E, "REFITS", refits)
        found.append([r["spread"] for r in E.expanding_gaussian(df, ["a", "b"], "y", "block", 0.5, "w", whole=True).table.orderBy("refit").collect()])
    assert "FlatMapCoGroups" not in plans[0] and "FlatMapCoGroups" in plans[1]
    assert len(found[0]) == 5
    for few, many in zip(*found, strict=True):
        assert few == pytest.approx(many)
