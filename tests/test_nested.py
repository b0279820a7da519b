"""Boosting of nested parts: cells hold all rows, models are those of one fit a part, limits are within a thousandth of the rows."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.operators import boosting as B
from skyledger.operators import gating as A
from skyledger.operators import nested as N


def frame(spark, n=3000):
    rng = np.random.default_rng(4)
    x, z, e = rng.integers(0, 12, n), rng.integers(0, 4, n), rng.normal(size=n)
    rows = [(float(a), None if i % 50 == 0 else float(b), 7.0, float(a + b + 2 * c > 7), 0.05 + float(i % 5), i * 3 // n) for i, (a, b, c) in enumerate(zip(x, z, e))]
    return spark.createDataFrame(rows, "x double, z double, same double, l double, w double, part int")


def test_models_of_nested_parts_are_those_of_a_fit_each(spark):
    df, features, upto = frame(spark), ["x", "z", "same"], [0, 1, 2]
    score = N.fit_nested(df, features, "l", "w", "part", upto, 20, 3)
    out = df
    for k, last in enumerate(upto):
        alone = B.fit_classifier(df.where(F.col("part") <= last), features, "l", "w", 20, 3)
        out = alone(out, f"alone{k}").withColumn(f"nested{k}", score(F.lit(k)))
    out = out.withColumn("none", score(F.lit(None).cast("int")))
    rows = out.select("none", *[f"{w}{k}" for k in range(3) for w in ("alone", "nested")]).collect()
    for k in range(3):
        assert np.allclose([r[f"alone{k}"] for r in rows], [r[f"nested{k}"] for r in rows], atol=1e-9)
    assert {r["none"] for r in rows} == {None} and len({round(r["nested0"] - r["nested2"], 9) for r in rows}) > 1


def test_cells_hold_the_weight_of_all_rows(spark):
    df = frame(spark).withColumns({"won": F.col("l") * F.col("w"), "lost": (1 - F.col("l")) * F.col("w")})
    rows = df.select("part", "won", "lost", *[B.value_of(f).alias(f"v{i}") for i, f in enumerate(("x", "z", "same"))])
    codes = N.Codes(N.nested_limits(rows, 3, [0, 1, 2]))
    blocks = N.cells(rows, codes).collect()
    assert sum(r["cells"] for r in blocks) <= 3 * 12 * 5 and {r["part"] for r in blocks} == {0, 1, 2}
    for column in ("won", "lost"):
        assert sum(np.frombuffer(r[column]).sum() for r in blocks) == pytest.approx(df.agg(F.sum(column)).first()[0])
    assert all(len(r["codes"]) == 3 * r["cells"] for r in blocks)


def test_limits_of_many_values_are_close_to_their_rank(spark, monkeypatch):
    monkeypatch.setattr(N, "SORTED_ROWS", 20_000)  # several sketches a task are merged and thinned
    n = 400_000
    rows = spark.range(n, numPartitions=2).select(
        (F.col("id") % 2).cast("int").alias("part"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("double").alias("v0"), F.when(F.col("id") % 3 == 0, F.lit(math.nan)).otherwise(F.col("id") % 40).cast("double").alias("v1")
    )
    values = [np.sort([r[0] for r in rows.where(F.col("part") <= last).select("v0").collect()]) for last in (0, 1)]
    found = N.nested_limits(rows, 2, [0, 1])
    for limits, own, ends in zip(found, values, (19, B.BINS - 1)):  # the first part has 20 values of v1, so all but the least are limits
        assert len(limits[0]) == B.BINS - 1 and len(limits[1]) == ends and set(limits[1]) <= set(map(float, range(40)))
        assert np.abs(np.searchsorted(own, limits[0]) / len(own) - np.arange(1, B.BINS) / B.BINS).max() < 1 / B.ACCURACY


def test_all_gates_are_learned_without_a_fit_a_fold(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    def refused(self, *_):
        raise AssertionError("a fit of its own for a fold")

    monkeypatch.setattr(GBTClassifier, "fit", refused)
    rng = np.random.default_rng(1)
    rows = [(dt.date(2026, 1, 1) + dt.timedelta(days=i), "C", y, y + (8.0 if i % 2 else 0.1), 1.0, y + (0.2 if i % 2 else 4.0), 1.0, float(i % 2)) for i, y in enumerate(map(float, rng.normal(15, 5, 200)))]
    df = spark.createDataFrame(rows, "target_date date, unit string, y double, primary_mean double, primary_std double, fallback_mean double, fallback_std double, s1 double")
    out = A.source_gated(df, "y", "unit", {"one": "s1"}, ["target_date"], target_date="target_date").collect()
    assert len(out) == 200 and {r["in_sample"] for r in out} == {True, False}
    assert np.mean([(r["fallback_weight"] > 0.5) == (r["fallback_crps"] < r["primary_crps"]) for r in out]) > 0.9


def test_moments_of_the_sources_there_are(spark):
    values = [(21.3, 21.3, 21.3), (1.5, None, -4.25), (None, 7.0, None), (None, None, None), (3.1, 3.2, 3.4)]
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, a double, b double, c double").select("i", *A.source_moments([F.col(x) for x in "abc"])).orderBy("i").collect()
    assert list(rows[0])[2:] == [0.0, 0.0] and list(rows[3])[1:] == [None] * 3
    for r, v in zip(rows, values):
        own = [x for x in v if x is not None]
        assert not own or list(r)[1:] == pytest.approx([np.mean(own), np.std(own), max(own) - min(own)])
    assert spark.range(1).select(*A.source_moments([])).first()[0] is None
