"""Boosted trees that learn from cells: rows whose features fall into the same bins train as one weighted row.

A tree sees a feature only by its bin. Rows of one cell stay together in every tree, so under squared loss their mean with
their weight, and under logistic loss one row a label, give the trees that the rows would give. There are as many cells as
combinations of bins that occur, at most as many as rows; MLlib passes over them instead of over the rows for every level of every tree.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.session import written

#: Bins of a feature, MLlib's default; missing values have one more behind them.
BINS = 32
#: Groups that a cell's rows are dealt into where trees learn from a share of the rows.
PARTS = 10
#: Share of the quantiles' error: a thousandth of the rows, where a bin holds a thirtieth.
ACCURACY = 1000


def value_of(feature: str) -> Column:
    """A feature as a number, NaN where it is missing."""
    return F.coalesce(F.col(feature).cast("double"), F.lit(math.nan))


def bin_limits(df: DataFrame, features: Sequence[str]) -> list[list[float]]:
    """Lower ends of each feature's bins but the first: every value where there are few, else quantiles of all rows.

    At most ``BINS - 1`` numbers a feature reach the driver, and twice as many values where they may be few.
    """
    there = [F.when(~F.isnan(value_of(f)), value_of(f)) for f in features]
    shares = [k / BINS for k in range(1, BINS)]
    found = df.agg(*[F.struct(F.approx_count_distinct(v), F.percentile_approx(v, shares, ACCURACY)) for v in there]).first()
    few = [i for i, (n, _) in enumerate(found) if n <= 2 * BINS]
    values = dict(zip(few, df.agg(*[F.collect_set(there[i]) for i in few]).first())) if few else {}
    limits = []
    for i, (_, quantiles) in enumerate(found):
        ends = sorted(values[i])[1:] if i in values and len(values[i]) <= BINS else sorted(set(quantiles or ()))
        limits.append([float(x) for x in ends if math.isfinite(x)])
    return limits


def binned(df: DataFrame, features: Sequence[str], limits: Sequence[Sequence[float]]) -> tuple[DataFrame, list[str]]:
    """Add each feature's bin, the last one for missing values; returns the names of the new columns too."""
    from pyspark.ml.feature import Bucketizer

    values, bins = [f"__v{i}" for i in range(len(features))], [f"__b{i}" for i in range(len(features))]
    splits = [[-math.inf, *(ends or [0.0]), math.inf] for ends in limits]
    ready = df.withColumns({v: value_of(f) for v, f in zip(values, features)})
    return Bucketizer(inputCols=values, outputCols=bins, splitsArray=splits, handleInvalid="keep").transform(ready).drop(*values), bins


def assembled(df: DataFrame, bins: Sequence[str]) -> DataFrame:
    """The bins as a plain vector: Bucketizer marks its columns as categories, but bins are in order."""
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("__x", array_to_vector(F.array(*bins))).drop(*bins)


def fit_regressor(
    train: DataFrame, features: Sequence[str], y: str, max_iter: int, depth: int, limits: Sequence[Sequence[float]] | None = None
) -> Callable[[DataFrame, str], DataFrame]:
    """Boosted regression, each tree on nine tenths of the rows; the result adds predictions as a named column.

    A cell's rows are dealt into parts by what they hold, and a tree leaves out parts. Rows without ``y`` are not learned from.
    ``limits`` are those of the same rows where they are known.
    """
    from pyspark.ml.regression import GBTRegressor

    known = train.where(F.col(y).isNotNull())
    limits = bin_limits(known, features) if limits is None else limits
    ready, bins = binned(known, features, limits)
    ready = ready.withColumn("__part", F.pmod(F.xxhash64(y, *features), F.lit(PARTS)))
    cells = ready.groupBy(*bins, "__part").agg(F.avg(F.col(y).cast("double")).alias("__y"), F.count("*").cast("double").alias("__w"))
    booster = GBTRegressor(
        featuresCol="__x", labelCol="__y", weightCol="__w", predictionCol="__p", maxIter=max_iter, maxDepth=depth, maxBins=BINS + 1, stepSize=0.1, subsamplingRate=0.9, seed=42
    )
    model = booster.fit(assembled(written(cells, "cells"), bins))

    def score(rows: DataFrame, into: str) -> DataFrame:
        return model.transform(assembled(*binned(rows, features, limits))).drop("__x").withColumnRenamed("__p", into)

    return score


def fit_classifier(train: DataFrame, features: Sequence[str], label: str, weight: str, max_iter: int, depth: int) -> Callable[[DataFrame, str], DataFrame]:
    """Boosted classification by weighted rows; the result adds the probability of label 1 as a named column."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    limits = bin_limits(train, features)
    ready, bins = binned(train, features, limits)
    cells = ready.groupBy(*bins, label).agg(F.sum(weight).alias(weight))
    gbt = GBTClassifier(featuresCol="__x", labelCol=label, weightCol=weight, maxIter=max_iter, maxDepth=depth, maxBins=BINS + 1, stepSize=0.1, seed=42)
    model = gbt.fit(assembled(written(cells, "cells"), bins))

    def score(rows: DataFrame, into: str) -> DataFrame:
        scored = model.transform(assembled(*binned(rows, features, limits)))
        return scored.withColumn(into, vector_to_array("probability")[1]).drop("__x", "rawPrediction", "probability", "prediction")

    return score
