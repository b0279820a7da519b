"""Boosting on cells: fits see cells, not rows; bins keep missing values; cells lose nothing."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.operators import boosting as B


def frame(spark, n=6000):
    rng = np.random.default_rng(4)
    rows = [(float(x), None if i % 50 == 0 else float(z), float(3 * (x > 5) + z + 0.1 * e)) for i, (x, z, e) in enumerate(zip(rng.integers(0, 12, n), rng.integers(0, 4, n), rng.normal(size=n)))]
    return spark.createDataFrame(rows, "x double, z double, y double")


def test_regressor_learns_from_cells_that_hold_all_rows(spark, monkeypatch):
    from pyspark.ml.regression import GBTRegressor

    seen, fit = [], GBTRegressor.fit

    def spied(self, data, *rest):
        seen.append(data.agg(F.count("*"), F.sum("__w"), F.sum(F.col("__w") * F.col("__y"))).first())
        return fit(self, data, *rest)

    monkeypatch.setattr(GBTRegressor, "fit", spied)
    df = frame(spark)
    score = B.fit_regressor(df.unionByName(df.limit(3).withColumn("y", F.lit(None).cast("double"))), ["x", "z"], "y", 20, 4)
    cells, weight, total = seen[0]
    assert cells <= 12 * 5 * B.PARTS < 6000 and weight == 6000
    assert total == pytest.approx(df.agg(F.sum("y")).first()[0])
    assert score(df, "p").agg(F.avg(F.abs(F.col("y") - F.col("p")))).first()[0] < 0.35


def test_limits_are_values_or_quantiles_and_missing_is_a_bin(spark):
    rows = [(float(i), float(i % 3) if i % 7 else math.nan, None) for i in range(1000)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    limits = B.bin_limits(df, ["a", "b", "c"])
    assert len(limits[0]) == B.BINS - 1 and limits[1:] == [[1.0, 2.0], []]
    out, bins = B.binned(df, ["a", "b", "c"], limits)
    found = out.groupBy(bins[1]).agg(F.count("*").alias("n"), F.min("b").alias("low"), F.max("b").alias("high")).orderBy(bins[1]).collect()
    assert [r["low"] for r in found][:3] == [0.0, 1.0, 2.0] and len(found) == 4 and math.isnan(found[3]["low"])
    assert max(r["count"] for r in out.groupBy(bins[0]).count().collect()) < 60


def test_classifier_weighs_cells_as_rows(spark):
    df = frame(spark, 3000).withColumns({"l": (F.col("x") + F.coalesce("z", F.lit(0.0)) > 7).cast("double"), "w": F.lit(1.0)})
    out = B.fit_classifier(df, ["x", "z"], "l", "w", 20, 3)(df, "p")
    assert out.where((F.col("p") > 0.5) != (F.col("l") == 1)).count() < 30
    assert "__x" not in out.columns and out.count() == 3000
