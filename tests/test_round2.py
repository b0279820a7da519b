"""Faults that the given tables do not show: missing features, wide weighted fits, jobs that run twice."""

import inspect

import numpy as np
import pytest

from skyledger.operators import models as M
from skyledger.operators import stacking as G
from skyledger.plans import q_models as Q
from skyledger.session import is_local, scratch_path, shared_dir
from skyledger.streaming import jobs as J


def closed_form(x, y, w, ridge):
    """Weighted ridge with a free intercept."""
    mx, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    cx, cy = x - mx, y - my
    beta = np.linalg.solve((cx * w[:, None]).T @ cx + ridge * np.eye(x.shape[1]), (cx * w[:, None]).T @ cy)
    return beta, my - mx @ beta


@pytest.mark.parametrize("width", [64, 65])
def test_weighted_ridge_is_one_algorithm_at_every_width(spark, width):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, width)) + 1e4
    y, w = x @ rng.normal(size=width) + rng.normal(size=400), rng.uniform(5, 20, 400)
    names = [f"f{i}" for i in range(width)]
    rows = [(*map(float, r), float(t), float(v)) for r, t, v in zip(x, y, w, strict=True)]
    df = spark.createDataFrame(rows, [*names, "y", "w"]).cache()
    fit = M.fit_linear(df, names, "y", "w", ridge=500.0)
    beta, intercept = closed_form(x, y, w, 500.0)
    assert np.allclose(fit.coefficients, beta, rtol=1e-6) and fit.intercept == pytest.approx(intercept, rel=1e-5)


def test_missing_features_count_as_their_median(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=300), rng.normal(size=300)
    y = 2 * a + 3 * b + 1
    gone = rng.random(300) < 0.3
    rows = [(None if g else float(p), float(q), float(t)) for p, q, t, g in zip(a, b, y, gone, strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    fit = M.fit_linear(df, ["a", "b"], "y")
    med = float(np.median(a[~gone]))
    beta, intercept = closed_form(np.column_stack((np.where(gone, med, a), b)), y, np.ones(300), 0.0)
    assert fit.medians == {"a": pytest.approx(med), "b": pytest.approx(float(np.median(b)))}
    assert np.allclose(fit.coefficients, beta) and fit.intercept == pytest.approx(intercept)
    assert df.select(fit.column().alias("p")).where("p IS NULL").count() == 0
    scored = M.fit_gaussian(df, ["a", "b"], "y").score(df)
    assert scored.where("pred_mean IS NULL OR pred_std IS NULL").count() == 0


def land(spark, path, first, n):
    rows = spark.range(first, first + n).selectExpr("id", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id AS int)) AS ts")
    rows.coalesce(1).write.mode("append").parquet(path)
    return rows.schema


def test_a_second_run_appends_its_records(spark):
    source, out = scratch_path(spark, "source"), scratch_path(spark, "log")
    for first, n in ((0, 10), (10, 20)):
        schema = land(spark, source, first, n)
        J.append_partitioned(J.read_files(spark, source, schema), out, "ts")
    assert spark.read.parquet(out).select("id").distinct().count() == 30 == spark.read.parquet(out).count()


def test_a_second_run_keeps_the_first_runs_epochs(spark):
    source, out = scratch_path(spark, "source"), scratch_path(spark, "epochs")
    for first, n in ((0, 10), (10, 20)):
        schema = land(spark, source, first, n)
        J.per_batch(J.read_files(spark, source, schema), lambda batch: batch, out)
    assert spark.read.parquet(out).count() == 30


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, key, default=None):
            return default

    class Jvm:
        _jsc = property(lambda self: self)

        def sc(self):
            return self

        def getCheckpointDir(self):
            return self

        def isDefined(self):
            return False

        def getConf(self):
            return Conf()

        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Jvm()

    assert is_local("local[8]") and not is_local("local-cluster[2,1,1024]") and not is_local("yarn")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_boosted_queries_fit_with_the_defaults_of_their_operators(spark, sf, monkeypatch):
    used = {}

    def record(module, name):
        operator = getattr(module, name)
        signature = inspect.signature(operator)

        def wrapped(*given, **named):
            bound = signature.bind(*given, **named)
            bound.apply_defaults()
            used[name] = {k: bound.arguments[k] == p.default for k, p in signature.parameters.items() if p.default is not p.empty}
            return operator(*given, **named)

        monkeypatch.setattr(module, name, wrapped)

    for module, name in ((M, "source_gate"), (M, "boosted_gaussian"), (G, "stacked_gaussian")):
        record(module, name)
    gate, boosted, stacked = Q.x13g(spark, sf).collect(), Q.x15(spark, sf).collect(), Q.x16(spark, sf).collect()
    assert len(used) == 3 and all(all(same.values()) for same in used.values()), used
    # facts that hold for any booster
    assert gate and all(0 <= r["fallback_weight"] <= 1 and r["pred_std"] > 0 and r["mae"] >= 0 for r in gate)
    assert boosted and stacked
