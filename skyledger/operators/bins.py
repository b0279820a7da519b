"""Predictive distributions on outcome bins.

A market's bins are a short array in schema order, so mapping, matching and
normalizing run inside the row and shuffle nothing.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skyledger.functions.numeric import MIN_STD, array_sum, let, normal_cdf_array
from skyledger.operators.asof import ordered_join
from skyledger.operators.quantiles import value_slice
from skyledger.session import written

FAR = 999.0


def bin_array(bins: list[tuple]) -> Column:
    """Literal bins from (label, lower, upper) or with inclusive flags."""
    out = []
    for b in bins:
        label, lower, upper, *flags = b
        low_in, high_in = flags if flags else (True, True)
        out.append(
            F.struct(
                F.lit(label).alias("label"),
                F.lit(lower).cast("double").alias("lower"),
                F.lit(upper).cast("double").alias("upper"),
                F.lit(low_in).alias("lower_inclusive"),
                F.lit(high_in).alias("upper_inclusive"),
            )
        )
    return F.array(*out)


def _low(b: Column, half: float) -> Column:
    return F.coalesce(b["lower"] - half, F.lit(float("-inf")))


def _high(b: Column, half: float) -> Column:
    return F.coalesce(b["upper"] + half, F.lit(float("inf")))


def resolves(b: Column, value: Column, half: float = 0.5) -> Column:
    """Settlement containment: half-open, inclusive flags ignored."""
    return (value >= _low(b, half)) & ((value < _high(b, half)) | b["upper"].isNull())


def contains(b: Column, value: Column) -> Column:
    """Containment that honours the inclusive flags."""
    above = b["lower"].isNull() | (value > b["lower"]) | (b["lower_inclusive"] & (value == b["lower"]))
    below = b["upper"].isNull() | (value < b["upper"]) | (b["upper_inclusive"] & (value == b["upper"]))
    return above & below


def winning_label(bins: Column, value: Column, half: float = 0.5) -> Column:
    """First bin in schema order that holds the value; null when none does."""
    return F.get(F.filter(bins, lambda b: resolves(b, value, half)), F.lit(0))["label"]


def normalize(masses: Column) -> Column:
    """Scale an array of masses to sum to one; uniform when there is no mass, the
    rounding residual goes to the first entry."""

    def scale(m: Column, total: Column) -> Column:
        even = F.lit(1.0) / F.size(m)
        return F.transform(m, lambda v: F.when(total > 0, v / total).otherwise(even))

    def settle(scaled: Column, total: Column) -> Column:
        residual = F.when(total > 0, 1.0 - array_sum(scaled)).otherwise(0.0)
        return let(residual, lambda r: F.transform(scaled, lambda v, i: F.when(i == 0, v + r).otherwise(v)))

    return let(masses, lambda m: let(array_sum(m), lambda t: let(scale(m, t), lambda s: settle(s, t))))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _normal_masses(lower: pa.Array, upper: pa.Array, mean: pa.Array, std: pa.Array) -> pa.Array:
    """Normalized Gaussian mass per bin; one batch of rows at a time.

    Bin bounds of a batch are one flat numpy array, so there is no work per row
    in Python. Interpreted array functions took 20 times as long here.
    """
    sizes = lower.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    bounds = [x.flatten().to_numpy(zero_copy_only=False).astype(float) for x in (lower, upper)]
    m = np.repeat(mean.to_numpy(zero_copy_only=False).astype(float), sizes)
    s = np.repeat(np.maximum(std.to_numpy(zero_copy_only=False).astype(float), MIN_STD), sizes)
    below = np.where(np.isnan(bounds[0]), 0.0, normal_cdf_array((bounds[0] - m) / s))
    above = np.where(np.isnan(bounds[1]), 1.0, normal_cdf_array((bounds[1] - m) / s))
    mass = np.maximum(above - below, 0.0)
    mass[np.isnan(m) | np.isnan(s)] = np.nan

    row = np.repeat(np.arange(len(sizes)), sizes)
    total = np.bincount(row, weights=mass, minlength=len(sizes))[row]
    even = 1.0 / np.maximum(sizes, 1)[row]
    scaled = np.where(total > 0, mass / np.where(total > 0, total, 1.0), even)
    residual = 1.0 - np.bincount(row, weights=scaled, minlength=len(sizes))
    first = offsets[:-1][sizes > 0]
    scaled[first] += np.where(total[first] > 0, residual[sizes > 0], 0.0)
    missing = np.isnan(mass)
    scaled[missing] = np.nan
    values = pa.array(scaled, mask=missing)
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), values)


def normal_masses(bins: Column, mean: Column, std: Column, half: float = 0.5) -> Column:
    """Gaussian probability of every bin, in bin order."""
    return _normal_masses(
        F.transform(bins, lambda b: b["lower"] - half),
        F.transform(bins, lambda b: b["upper"] + half),
        mean.cast("double"),
        std.cast("double"),
    )


def sample_masses(bins: Column, samples: Column, half: float = 0.5) -> Column:
    """Share of samples in every bin, in bin order."""

    def masses(drawn: Column) -> Column:
        n = F.greatest(F.size(drawn), F.lit(1))
        return F.transform(bins, lambda b: F.size(F.filter(drawn, lambda s: resolves(b, s, half))) / n)

    return normalize(let(samples, masses))


def labeled(bins: Column, masses: Column) -> Column:
    """Array of (label, prob) structs."""
    return F.zip_with(bins, masses, lambda b, m: F.struct(b["label"].alias("label"), m.alias("prob")))


def top_outcome(probs: Column) -> Column:
    """Most probable (label, prob) entry; the first wins a tie."""
    return F.aggregate(
        F.slice(probs, F.lit(2), F.greatest(F.size(probs) - 1, F.lit(0))),
        F.get(probs, F.lit(0)),
        lambda best, p: F.when(p["prob"] > best["prob"], p).otherwise(best),
    )


def brier(probs: Column, winner: Column) -> Column:
    """Mean squared error over the labels of one market."""
    squared = F.transform(probs, lambda p: F.pow(p["prob"] - F.when(p["label"] == winner, 1.0).otherwise(0.0), F.lit(2.0)))
    return F.aggregate(squared, F.lit(0.0), lambda acc, v: acc + v) / F.size(probs)


def observation_adjusted(bins: Column, probs: Column, observed: Column) -> Column:
    """Struct of adjusted probabilities, impossible labels and removed mass.

    Bins whose upper bound lies below the observed maximum get no mass; the
    others are scaled up, or made uniform where they hold none. Without any
    feasible bin the input stays.
    """
    rows = F.zip_with(
        bins,
        probs,
        lambda b, p: F.struct(
            b["label"].alias("label"),
            p["prob"].alias("prob"),
            F.coalesce(observed > b["upper"], F.lit(False)).alias("out"),
        ),
    )

    def adjust(r: Column) -> Column:
        return let(F.filter(r, lambda x: ~x["out"]), lambda feasible: weigh(r, feasible))

    def weigh(r: Column, feasible: Column) -> Column:
        mass = F.aggregate(feasible, F.lit(0.0), lambda acc, x: acc + F.greatest(x["prob"], F.lit(0.0)))
        return let(F.struct(mass.alias("mass"), F.size(feasible).alias("n")), lambda t: result(r, t))

    def result(r: Column, t: Column) -> Column:
        def share(x: Column) -> Column:
            scaled = F.when(t["mass"] > 0, F.greatest(x["prob"], F.lit(0.0)) / t["mass"]).otherwise(F.lit(1.0) / t["n"])
            return F.when(t["n"] == 0, x["prob"]).when(x["out"], 0.0).otherwise(scaled)

        return F.struct(
            F.transform(r, lambda x: F.struct(x["label"].alias("label"), share(x).alias("prob"))).alias("probs"),
            F.transform(F.filter(r, lambda x: x["out"]), lambda x: x["label"]).alias("impossible"),
            F.when(t["n"] == 0, 0.0).otherwise(F.greatest(1.0 - t["mass"], F.lit(0.0))).alias("removed_mass"),
        )

    return let(rows, adjust)


def impossible_price_mass(impossible: Column, asks: Column) -> Column:
    """Sum of best asks over impossible labels; null when none has an ask.

    ``asks`` is an array of (label, ask) with null for a missing ask.
    """
    hits = F.filter(asks, lambda a: F.array_contains(impossible, a["label"]) & a["ask"].isNotNull())
    return F.when(F.size(hits) > 0, F.aggregate(hits, F.lit(0.0), lambda acc, a: acc + a["ask"]))


def bin_position(bins: Column, value: Column) -> Column:
    """Struct describing where a forecast lies in the bins: rank, normalized rank,
    tail flags and distance to the nearest boundary (999 for an open side).

    Closed containment, points widened by half a degree; outside every bin the
    nearest midpoint decides.
    """
    spans = F.transform(
        bins,
        lambda b, i: F.struct(
            i.alias("i"),
            F.coalesce(F.when(b["lower"] == b["upper"], b["lower"] - 0.5).otherwise(b["lower"]), F.lit(float("-inf"))).alias("lo"),
            F.coalesce(F.when(b["lower"] == b["upper"], b["upper"] + 0.5).otherwise(b["upper"]), F.lit(float("inf"))).alias("hi"),
            F.abs(
                value
                - (F.coalesce(b["lower"], F.lit(0.0)) + F.coalesce(b["upper"], b["lower"], F.lit(0.0))) / 2.0
            ).alias("gap"),
            F.least(
                F.coalesce(F.abs(value - b["lower"]), F.lit(FAR)), F.coalesce(F.abs(b["upper"] - value), F.lit(FAR))
            ).alias("edge"),
        ),
    )
    inside = F.get(F.filter(spans, lambda s: (value >= s["lo"]) & (value <= s["hi"])), F.lit(0))
    nearest = F.array_min(F.transform(spans, lambda s: F.struct(s["gap"].alias("gap"), s["i"].alias("i"), s["edge"].alias("edge"))))
    rank = F.coalesce(inside["i"], nearest["i"])
    n = F.size(bins)
    return F.struct(
        rank.alias("bin_rank"),
        (rank / F.greatest(n - 1, F.lit(1))).alias("bin_rank_norm"),
        n.alias("n_bins"),
        (rank == 0).alias("is_lower_tail_bin"),
        (rank == n - 1).alias("is_upper_tail_bin"),
        F.coalesce(inside["edge"], nearest["edge"]).alias("bin_boundary_dist"),
    )


def boundary_distance(bins: Column, value: Column) -> Column:
    """Distance to the nearest boundary of the matched bin; half-open match, open
    ends at +-999, nearest midpoint otherwise, fully open bins skipped."""
    spans = F.transform(
        F.filter(bins, lambda b: b["lower"].isNotNull() | b["upper"].isNotNull()),
        lambda b, i: F.struct(
            i.alias("i"),
            F.coalesce(F.when(b["lower"] == b["upper"], b["lower"] - 0.5).otherwise(b["lower"]), F.lit(-FAR)).alias("lo"),
            F.coalesce(F.when(b["lower"] == b["upper"], b["upper"] + 0.5).otherwise(b["upper"]), F.lit(FAR)).alias("hi"),
            F.least(
                F.coalesce(F.abs(value - b["lower"]), F.lit(FAR)), F.coalesce(F.abs(b["upper"] - value), F.lit(FAR))
            ).alias("edge"),
        ),
    )
    inside = F.get(F.filter(spans, lambda s: (value >= s["lo"]) & (value < s["hi"])), F.lit(0))
    nearest = F.array_min(
        F.transform(
            spans,
            lambda s: F.struct(F.abs(value - (s["lo"] + s["hi"]) / 2.0).alias("gap"), s["i"].alias("i"), s["edge"].alias("edge")),
        )
    )
    return F.coalesce(inside["edge"], nearest["edge"])


def range_join_bins(values: DataFrame, bins: DataFrame, keys: list[str], value: str, half: float = 0.5) -> DataFrame:
    """Table form: bins are rows (keys, ordinal, label, lower, upper).

    Values never meet the bins one by one. A market's axis is cut at the borders of its bins; a bin
    covers a stretch of pieces, which is at most two blocks of 2^k pieces for each k, and a piece lies in
    one block for each k. So the first matching ordinal of a piece comes from an equi-join of logarithmic size. The last border at
    or before a distinct value is its piece, and the answer is joined back by market and value.
    """
    b = bins.select(
        *keys,
        "ordinal",
        F.col("label").alias("winning_label"),
        F.coalesce(F.col("lower") - half, F.lit(float("-inf"))).alias("__lo"),
        F.coalesce(F.col("upper") + half, F.lit(float("inf"))).alias("__hi"),
    )
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    first = [F.min_by("winning_label", "ordinal").alias("winning_label"), F.min("ordinal").alias("ordinal")]
    b = b.where(known & (F.col("__lo") < F.col("__hi"))).groupBy(*keys, "__lo", "__hi").agg(*first)
    b = written(b.where(F.col("ordinal").isNotNull()), "range-bins")
    borders = b.select(*keys, F.explode(F.array("__lo", "__hi")).alias("__at")).distinct()
    borders = written(borders.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy("__at")) - 1), "range-borders")
    placed = b.join(borders.select(*keys, F.col("__at").alias("__lo"), F.col("__i").alias("__from")), [*keys, "__lo"])
    placed = placed.join(borders.select(*keys, F.col("__at").alias("__hi"), F.col("__i").alias("__to")), [*keys, "__hi"])
    placed = placed.withColumn("__k", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("__to") - F.col("__from"))).cast("int"))))
    low, high = F.expr("shiftright(__from + shiftleft(1, __k) - 1, __k)"), F.expr("shiftright(__to, __k)")
    ends = F.array(F.when((low < high) & (low % 2 == 1), low), F.when((low < high) & (high % 2 == 1), high - 1))
    blocks = placed.withColumn("__block", F.explode(F.array_distinct(ends))).where(F.col("__block").isNotNull())
    blocks = blocks.groupBy(*keys, "__k", "__block").agg(*first)
    last = borders.groupBy(*keys).agg(F.max("__i").alias("__last"))
    depth = F.floor(F.log2(F.greatest("__last", F.lit(1)))).cast("int")
    pieces = borders.join(last, keys).withColumn("__k", F.explode(F.sequence(F.lit(0), depth))).withColumn("__block", F.expr("shiftright(__i, __k)"))
    pieces = pieces.join(blocks, [*keys, "__k", "__block"], "left").groupBy(*keys, "__at").agg(*first)
    pieces = pieces.select(*keys, F.col("__at").alias("__start"), "winning_label")
    wanted = values.select(*keys, F.col(value).cast("double").alias("__v")).where(F.col(value).isNotNull() & known).distinct()
    near = lambda at: value_slice(F.greatest(F.least(at, F.lit(1e300)), F.lit(-1e300)), 64)
    hit = ordered_join(wanted, pieces, keys, F.col("__v"), F.col("__start"), near, ["winning_label"], position_as="__piece")
    first = hit.where(F.col("winning_label").isNotNull()).select(*keys, "__v", "winning_label")
    values = values.withColumn("__v", F.col(value).cast("double"))
    return values.join(first, [*keys, "__v"], "left").drop("__v")
