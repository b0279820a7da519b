"""Numeric column expressions: normal CDF, CRPS, row statistics, units."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of the double-precision normal distribution
# function published by G. West, "Better approximations to cumulative normal
# functions" (2005), highest power first.
CDF_NUMERATOR = (
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
CDF_DENOMINATOR = (
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
CDF_CENTRAL_LIMIT = 7.07106781186547
MIN_STD = 1e-6


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    Column functions are inlined wherever they are used; inside nested array
    functions that would repeat the work for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _horner(x: Column, coefficients: Sequence[float]) -> Column:
    value = F.lit(coefficients[0])
    for c in coefficients[1:]:
        value = value * x + F.lit(c)
    return value


def std_normal_cdf(z: Column) -> Column:
    """P(Z <= z), accurate to about 1e-15, as one codegen-friendly expression."""
    a = F.abs(z)
    density = F.exp(-a * a / 2.0)
    central = density * _horner(a, CDF_NUMERATOR) / _horner(a, CDF_DENOMINATOR)
    fraction = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = a + F.lit(k) / fraction
    tail = density / fraction / F.lit(2.506628274631)
    upper = F.when(a > 37.0, F.lit(0.0)).when(a < CDF_CENTRAL_LIMIT, central).otherwise(tail)
    # One use of ``upper`` keeps the generated code within the JVM's method limit.
    return 0.5 + F.signum(z) * (0.5 - upper)


def normal_cdf(x: Column, mean: Column, std: Column) -> Column:
    """Normal CDF with the standard deviation floored at 1e-6."""
    return std_normal_cdf((x - mean) / F.greatest(std, F.lit(MIN_STD)))


def normal_cdf_array(z):
    """The same approximation over a numpy array, for use inside Arrow functions."""
    import numpy as np

    a = np.abs(z)
    with np.errstate(over="ignore", invalid="ignore"):
        density = np.exp(-a * a / 2.0)
        central = density * np.polyval(CDF_NUMERATOR, a) / np.polyval(CDF_DENOMINATOR, a)
        fraction = a + 0.65
        for k in (4.0, 3.0, 2.0, 1.0):
            fraction = a + k / fraction
        tail = density / fraction / 2.506628274631
    upper = np.where(a > 37.0, 0.0, np.where(a < CDF_CENTRAL_LIMIT, central, tail))
    return np.where(z > 0, 1.0 - upper, upper)


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2.0) / F.lit(math.sqrt(2.0 * math.pi))


def gaussian_crps(mean: Column, std: Column, y: Column) -> Column:
    """Closed-form CRPS of a Gaussian forecast."""
    sigma = F.greatest(std, F.lit(MIN_STD))
    z = (y - mean) / sigma
    return sigma * (z * (2.0 * std_normal_cdf(z) - 1.0) + 2.0 * normal_pdf(z) - F.lit(1.0 / math.sqrt(math.pi)))


def with_gaussian_crps(df: DataFrame, mean: str, std: str, actual: str, into: str = "crps") -> DataFrame:
    """The CRPS as a column, with the standard score in a projection of its own so
    that the generated code stays small."""
    sigma = F.greatest(F.col(std), F.lit(MIN_STD))
    z = F.col("__z")
    score = sigma * (z * (2.0 * std_normal_cdf(z) - 1.0) + 2.0 * normal_pdf(z) - F.lit(1.0 / math.sqrt(math.pi)))
    return df.withColumn("__z", (F.col(actual) - F.col(mean)) / sigma).withColumn(into, score).drop("__z")


def gaussian_nll(mean: Column, std: Column, y: Column) -> Column:
    """Negative log-likelihood of a Gaussian forecast, sigma clipped at 1e-6."""
    sigma = F.greatest(std, F.lit(MIN_STD))
    return 0.5 * F.log(F.lit(2.0 * math.pi) * sigma * sigma) + 0.5 * F.pow((y - mean) / sigma, F.lit(2.0))


def sample_crps(samples: Column, y: Column) -> Column:
    """CRPS of an array of samples in O(n log n).

    Half the mean pairwise distance equals sum((2i - n - 1) x_(i)) / n^2 over
    the sorted samples, so no n x n matrix is formed.
    """
    def score(ordered: Column) -> Column:
        n = F.size(ordered).cast("double")
        distance = F.aggregate(ordered, F.lit(0.0), lambda acc, s: acc + F.abs(s.cast("double") - y)) / n
        weighted = F.transform(ordered, lambda s, i: (2.0 * (i + 1) - n - 1.0) * s.cast("double"))
        return distance - F.aggregate(weighted, F.lit(0.0), lambda acc, s: acc + s) / (n * n)

    return F.when(F.size(samples) > 0, let(F.array_sort(samples), score))


def present(values: Sequence[Column]) -> Column:
    """Array of the non-null values among several columns."""
    return F.filter(F.array(*values), lambda v: v.isNotNull())


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def array_mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, array_sum(values) / F.size(values))


def array_variance(values: Column, ddof: int = 0) -> Column:
    """Variance of an array; null when there are not more than ``ddof`` values."""
    n = F.size(values)
    total = F.aggregate(
        values,
        F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")),
        lambda acc, v: F.struct(
            (acc["n"] + 1.0).alias("n"),
            (acc["mean"] + (v.cast("double") - acc["mean"]) / (acc["n"] + 1.0)).alias("mean"),
            (
                acc["m2"]
                + (v.cast("double") - acc["mean"])
                * (v.cast("double") - acc["mean"])
                * acc["n"]
                / (acc["n"] + 1.0)
            ).alias("m2"),
        ),
    )
    return F.when(n > ddof, total["m2"] / (n - ddof))


def array_std(values: Column, ddof: int = 0) -> Column:
    return F.sqrt(array_variance(values, ddof))


def array_range(values: Column) -> Column:
    return F.array_max(values) - F.array_min(values)


def mixture_moments(weights: Column, means: Column, stds: Column) -> Column:
    """Mean and standard deviation of a finite Gaussian mixture (arrays)."""
    total = array_sum(weights)
    mean = array_sum(F.zip_with(weights, means, lambda w, m: w * m)) / total
    second = (
        array_sum(
            F.zip_with(
                weights,
                F.zip_with(stds, means, lambda s, m: s * s + m * m),
                lambda w, q: w * q,
            )
        )
        / total
    )
    return F.struct(mean.alias("mean"), F.sqrt(F.greatest(second - mean * mean, F.lit(MIN_STD**2))).alias("std"))


def to_celsius(value: Column, unit: Column, scale: bool = False) -> Column:
    """Unit-aware conversion; ``scale=True`` is for amplitudes and deviations."""
    fahrenheit = value * 5.0 / 9.0 if scale else (value - 32.0) * 5.0 / 9.0
    return F.when(F.upper(unit) == "F", fahrenheit).otherwise(value)


def from_celsius(value: Column, unit: Column, scale: bool = False) -> Column:
    fahrenheit = value * 9.0 / 5.0 if scale else value * 9.0 / 5.0 + 32.0
    return F.when(F.upper(unit) == "F", fahrenheit).otherwise(value)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def truthy(value: Column) -> Column:
    """Nullable flag arriving as bool, int or text."""
    return F.lower(F.trim(value.cast("string"))).isin("true", "1", "1.0", "yes", "y")
