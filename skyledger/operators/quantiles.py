"""Exact grouped quantiles that never hold a whole group in one task.

``percentile`` keeps every distinct value of a group in one aggregation
buffer. Here equal values are first counted (map-side), then a group is cut
into value slices whose borders depend on the value alone. Slice counts give
the slice each wanted rank falls into, and only those slices are ranked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLICES_PER_OCTAVE = 4096


def value_slice(value: Column, per_octave: int = SLICES_PER_OCTAVE) -> Column:
    """Order-preserving slice number of a double, finer near zero."""
    magnitude = F.floor((F.log2(F.abs(value)) + 1100.0) * per_octave) + 1
    return F.when(value == 0, F.lit(0).cast("bigint")).when(value > 0, magnitude).otherwise(-magnitude)


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    method: str = "linear",
) -> DataFrame:
    """One row per group with the exact quantiles named in ``quantiles``.

    ``method="linear"`` interpolates between neighbours (the usual median);
    ``method="upper"`` takes the element at index ``floor(n * q)`` of the sorted
    values, which for q = 0.5 is the upper median. Null values are ignored, and
    keys may be null.
    """
    keys = list(keys)
    gk = [f"__k{i}" for i in range(len(keys))]
    base = df.select(
        *[F.col(k).alias(a) for k, a in zip(keys, gk)], F.col(value).cast("double").alias("__v")
    )
    # Counting the value gives the null group a weight of 0. A null filter would be
    # pushed below the projection and compute a costly value expression twice.
    counts = base.groupBy(*gk, "__v").agg(F.count("__v").alias("__c")).withColumn("__s", value_slice(F.col("__v")))

    slices = counts.groupBy(*gk, "__s").agg(F.sum("__c").alias("__n"))
    along = Window.partitionBy(*gk) if gk else Window.partitionBy(F.lit(0))
    ordered = along.orderBy("__s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = slices.withColumn("__end", F.sum("__n").over(ordered)).withColumn("__total", F.sum("__n").over(along))

    wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in quantiles.items()])
    targets = slices.withColumn("__q", F.explode(wanted))
    if method == "upper":
        position = F.least(F.floor(F.col("__total") * F.col("__q.q")), F.col("__total") - 1).cast("double")
    else:
        position = (F.col("__total") - 1) * F.col("__q.q")
    targets = targets.withColumn("__pos", position).withColumn(
        "__rank", F.explode(F.array_distinct(F.array(F.floor("__pos"), F.ceil("__pos"))))
    )
    start = F.col("__end") - F.col("__n")
    targets = targets.where((F.col("__rank") >= start) & (F.col("__rank") < F.col("__end"))).select(
        *[F.col(k).alias(f"__t{k}") for k in gk],
        F.col("__s").alias("__ts"),
        F.col("__q.name").alias("__name"),
        "__pos",
        "__rank",
        (F.col("__rank") - start).alias("__local"),
    )

    inside = Window.partitionBy(*gk, "__s").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = [F.col(k).eqNullSafe(F.col(f"__t{k}")) for k in gk] + [F.col("__s") == F.col("__ts")]
    on = reduce(lambda a, b: a & b, same)
    hit_slices = targets.select(*[F.col(f"__t{k}") for k in gk], "__ts").distinct()
    ranked = (
        counts.join(hit_slices, on, "left_semi")
        .withColumn("__upto", F.sum("__c").over(inside))
        .join(targets, on)
        .where((F.col("__local") < F.col("__upto")) & (F.col("__local") >= F.col("__upto") - F.col("__c")))
    )

    # At most two neighbours per quantile: weight them into the interpolated value.
    weight = F.when(F.floor("__pos") == F.ceil("__pos"), 1.0).otherwise(1.0 - F.abs(F.col("__rank") - F.col("__pos")))
    picked = ranked.select(*gk, "__name", (F.col("__v") * weight).alias("__part"))
    out = picked.groupBy(*gk).agg(
        *[F.sum(F.when(F.col("__name") == n, F.col("__part"))).alias(n) for n in quantiles]
    )
    return out.select(*[F.col(a).alias(k) for k, a in zip(keys, gk)], *quantiles)


def many_quantiles(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Quantiles of several columns per group in one job: {column: {name: q}}."""
    if len(wanted) == 1:
        ((column, named),) = wanted.items()
        return grouped_quantiles(df, keys, column, named)
    pairs = F.array(*[F.struct(F.lit(c).alias("__metric"), F.col(c).cast("double").alias("__value")) for c in wanted])
    levels = {f"q{i}": q for i, q in enumerate(sorted({q for named in wanted.values() for q in named.values()}))}
    long = df.select(*keys, F.inline(pairs))
    found = grouped_quantiles(long, [*keys, "__metric"], "__value", levels)
    column_of = {q: n for n, q in levels.items()}
    picks = [
        F.max(F.when(F.col("__metric") == c, F.col(column_of[q]))).alias(name)
        for c, named in wanted.items()
        for name, q in named.items()
    ]
    return found.groupBy(*keys).agg(*picks)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on keys where null equals null; keeps the left key columns."""
    if not keys:
        raise ValueError("null_safe_join needs at least one key")
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    joined = left.join(renamed, on, how)
    return joined.drop(*[f"__r_{k}" for k in keys]) if how not in ("left_semi", "left_anti") else joined


def with_quantiles(
    summary: DataFrame,
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    method: str = "linear",
) -> DataFrame:
    """Attach exact quantiles to a per-group summary (no keys: a one-row summary)."""
    found = grouped_quantiles(df, keys, value, quantiles, method)
    if keys:
        return null_safe_join(summary, found, keys)
    return summary.select("*", *[found.select(n).scalar().alias(n) for n in quantiles])
