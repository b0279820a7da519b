"""Source gating: features, weights, folds, the constant gate."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.operators import gating as A
from skyledger.operators import models as M

SCHEMA = "city string, target_date date, decision_horizon string, lead_hours double, unit string, y double, primary_mean double, primary_std double, fallback_mean double, fallback_std double, s1 double, s2 double"
ABOUT = dict(lead_hours="lead_hours", target_date="target_date", one_hot=("city", "decision_horizon"))


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_moments_blend_in_celsius_for_fahrenheit_markets(spark):
    df = spark.createDataFrame([("F", 50.0, 3.6, 68.0, 9.0, 0.5)], "unit string, primary_mean double, primary_std double, fallback_mean double, fallback_std double, w double")
    r = M.gated_mixture(df, "w", "unit").first()
    assert r["pred_mean"] == pytest.approx(59.0) and r["pred_std"] == pytest.approx(np.sqrt(39.5) * 1.8)


def test_a_fallback_that_always_wins_gets_all_weight(spark):
    rows = [("Atlanta", dt.date(2026, 1, 1) + dt.timedelta(days=i), "market_open", 1.0 + i, "C", 10.0 + i, 2.0 + i, 1.0, 10.0 + i, 1.0, None, 5.0) for i in range(24)]
    out = A.source_gated(frame(spark, rows), "y", "unit", {"one": "s1", "two": "s2"}, **ABOUT).collect()
    assert all(r["fallback_weight"] == 1.0 and r["pred_mean"] == pytest.approx(r["y"]) and r["in_sample"] for r in out) and len(out) == 24


def mixed(n=200):
    rng = np.random.default_rng(2)
    out = []
    for i in range(n):
        bad = i % 2 == 0  # the primary is off where the second source is far from it
        y = float(rng.normal(15, 5))
        out.append(("B" if i % 3 else None, dt.date(2026, 1, 1) + dt.timedelta(days=i), "h", float(i % 24), "C", y, y + (8.0 if bad else 0.1), 1.0, y + (0.2 if bad else 4.0), 1.0, y, y + (9.0 if bad else 0.0)))
    return out


def test_folds_are_scored_by_earlier_groups_and_learn(spark):
    rows = mixed() + [("B", dt.date(2026, 12, 1), "h", None, "C", None, 10.0, 1.0, 11.0, 1.0, None, None)]
    out = A.source_gated(frame(spark, rows), "y", "unit", {"one": "s1", "two": "s2"}, ["target_date"], low=0.05, high=0.95, weight_mode="absolute_regret", **ABOUT).collect()
    assert len(out) == len(rows) and {r["in_sample"] for r in out} == {True, False}
    later = [r for r in out if not r["in_sample"] and r["y"] is not None]
    assert len(later) > 100 and all(0.05 <= r["fallback_weight"] <= 0.95 for r in out)
    right = [(r["fallback_weight"] > 0.5) == (r["fallback_crps"] < r["primary_crps"]) for r in later]
    assert np.mean(right) > 0.9
    assert [r["primary_crps"] for r in out if r["y"] is None] == [None]


def test_features_in_celsius_with_missing_sources(spark):
    rows = [("X", dt.date(2026, 2, 1), "h", 6.0, "F", 50.0, 50.0, 1.8, 59.0, 3.6, 32.0, None), (None, None, None, None, "C", 1.0, 3.0, 1.0, 2.0, 1.0, None, None)]
    out, names = A.gate_features(frame(spark, rows), "unit", {"one": "s1", "two": "s2"}, lead_hours="lead_hours", target_date="target_date", one_hot={"city": ["X", "unknown"]})
    f, c = (r.asDict() for r in out.orderBy(F.desc("unit")).collect())
    assert f["gate_primary_mean_c"] == pytest.approx(10.0) and f["gate_mean_diff_c"] == pytest.approx(-5.0) and f["gate_std_diff_c"] == pytest.approx(-1.0)
    assert f["gate_one_daily_max_c"] == pytest.approx(0.0) and f["gate_one_delta_vs_fallback_c"] == pytest.approx(-15.0)
    assert (f["gate_avail__one"], f["gate_avail__two"], f["gate_available_source_fraction"], f["gate_sentinel_daily_max_count"]) == (1, 0, 0.5, 1)
    assert (f["gate_source_std_c"], f["gate_source_range_c"], f["gate_two_daily_max_c"], f["gate_target_month"]) == (0, 0, A.MISSING, 2)
    assert (c["gate_source_mean_c"], c["gate_lead_hours"], c["gate_target_month"]) == (A.MISSING, 0, 0)
    hot = [n for n in names if n.startswith("gate_city__")]
    assert [f[n] for n in hot] == [1, 0] and [c[n] for n in hot] == [0, 1]


def test_regret_weights_have_mean_one(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    seen = []
    fit = GBTClassifier.fit

    def spied(self, data, *rest):
        seen.append(data.agg(F.avg("__w"), F.min("__w"), F.max("__w")).first())
        return fit(self, data, *rest)

    monkeypatch.setattr(GBTClassifier, "fit", spied)
    df = spark.createDataFrame([(float(i), 1.0 if i % 2 else 2.0, 5.0 if i % 4 == 1 else 1.5) for i in range(40)], "x double, primary_crps double, fallback_crps double")
    M.source_gate(df, ["x"], weight_mode="fallback_regret", max_iter=1)
    mean, low, high = seen[0]
    assert mean == pytest.approx(1.0) and high / low == pytest.approx(0.55 / 0.05)
