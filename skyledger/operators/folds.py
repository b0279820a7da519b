"""Chronological ordinals, expanding folds, holdouts and recency weights.

Folds are kept as a group ordinal: training rows of fold k are those with an
ordinal below its start, so no row is copied per fold.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.session import written

CANONICAL_ORDER = ("target_date", "decision_time_utc", "market_id", "decision_horizon")


def canonical_order(df: DataFrame) -> list[str]:
    return [c for c in CANONICAL_ORDER if c in df.columns]


def global_ordinal(df: DataFrame, order: Sequence[str], into: str = "ordinal") -> DataFrame:
    """0-based position of every row in a total order, without a one-task sort.

    Rows are range-partitioned on the order columns, which balances parts of any
    distribution, and written with their part number so that a recomputed task
    cannot move them. A part starts at the row count of the parts before it; only
    that table, one row per part, is ordered as a whole.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ordinal")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("__part")
        .agg(F.count("*").alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    inside = Window.partitionBy("__part").orderBy(*order)
    numbered = placed.withColumn("__i", F.row_number().over(inside) - 1).join(starts, "__part")
    return numbered.withColumn(into, (F.col("__start") + F.col("__i")).cast("bigint")).drop("__part", "__start", "__i")


def group_ordinal(df: DataFrame, group: Sequence[str], into: str = "ordinal") -> DataFrame:
    """One row per group with its place by first appearance in canonical order.

    Groups carry the least order key of their rows, a map-side aggregate. Where the order begins with the group's
    own columns, these decide alone.
    """
    order = canonical_order(df)
    if group and set(order[: len(group)]) == set(group):
        return global_ordinal(df.select(*group).distinct(), order[: len(group)], into)
    first = df.groupBy(*group).agg(F.min(F.struct(*order)).alias("__first"))
    flat = first.select(*group, *[F.col(f"__first.{c}").alias(f"__o_{c}") for c in order])
    ranked = [f"__o_{c}" for c in order]
    return global_ordinal(flat, ranked, into).drop(*ranked)


def expanding_folds(df: DataFrame, group: Sequence[str], min_train: int, test_size: int) -> DataFrame:
    """Rows with their group ordinal and the fold that tests them (null: never).

    Fold k trains on ordinals below ``min_train + k * test_size``.
    """
    ordinals = group_ordinal(df, group).select(*[F.col(g).alias(f"__g_{g}") for g in group], "ordinal")
    on = [df[g].eqNullSafe(ordinals[f"__g_{g}"]) for g in group]
    out = df.join(ordinals, on).drop(*[f"__g_{g}" for g in group])
    fold = F.when(F.col("ordinal") >= min_train, F.floor((F.col("ordinal") - min_train) / test_size))
    return out.withColumn("fold", fold)


def fold_sizes(folded: DataFrame, min_train: int, test_size: int) -> DataFrame:
    """Train and test rows of every fold from per-fold counts."""
    per = folded.groupBy("fold").agg(F.count("*").alias("rows"))
    upto = Window.orderBy(F.asc_nulls_first("fold")).rowsBetween(Window.unboundedPreceding, -1)
    return per.select("fold", F.col("rows").alias("test_rows"), F.sum("rows").over(upto).alias("train_rows")).where(
        F.col("fold").isNotNull()
    )


def date_folds(df: DataFrame, date: str, folds: int) -> DataFrame:
    """Split the distinct dates into ``folds + 1`` parts; all but the first are folds."""
    dates = df.select(F.col(date).alias("__d")).where(F.col("__d").isNotNull()).distinct()
    ranked = dates.withColumn("__o", F.row_number().over(Window.orderBy("__d")) - 1).withColumn(
        "__n", F.count("*").over(Window.partitionBy(F.lit(0)))
    )
    fold = F.lit(None).cast("int")
    for k in range(folds):
        fold = F.when(F.col("__o") >= F.floor(F.col("__n") * (k + 1) / (folds + 1)), k + 1).otherwise(fold)
    marked = ranked.select("__d", fold.alias("fold")).where(F.col("fold").isNotNull())
    return df.join(marked, df[date] == marked["__d"]).drop("__d")


def validation_folds(df: DataFrame, group: Sequence[str], n_splits: int = 4, min_train: int = 16) -> DataFrame:
    """Rows with their group ordinal and the fold that validates them (null: none).

    A validation part is 1/(n_splits + 1) of the groups. The first starts after
    ``min_train`` groups, the rest follow while they are full; where none fits,
    the last 20 % of the groups are the only fold.
    """
    ordinals = group_ordinal(df, group).select(*[F.col(g).alias(f"__g_{g}") for g in group], "ordinal")
    n = ordinals.agg(F.count("*")).scalar()
    sized = ordinals.withColumn("__n", n)
    size = F.greatest(F.floor(F.col("__n") / max(n_splits + 1, 2)), F.lit(1))
    first = F.greatest(F.lit(min_train), size)
    k = F.floor((F.col("ordinal") - first) / size)
    regular = F.when((k >= 0) & (first + (k + 1) * size <= F.col("__n")), k)
    tail_start = F.col("__n") - F.greatest(F.ceil(F.col("__n") * 0.2), F.lit(1))
    tail = F.when((tail_start > 0) & (F.col("ordinal") >= tail_start), F.lit(0))
    fold = F.when(first + size <= F.col("__n"), regular).otherwise(tail).cast("bigint")
    # written: few groups then meet the rows where they lie
    marked = written(sized.withColumn("fold", fold).drop("__n"), "folds")
    on = [df[g].eqNullSafe(marked[f"__g_{g}"]) for g in group]
    return df.join(marked, on).drop(*[f"__g_{g}" for g in group])


def holdout(df: DataFrame, group: Sequence[str], share: float = 0.2) -> DataFrame:
    """Mark the last ``share`` of groups as test rows, the rest as train."""
    ordinals = group_ordinal(df, group).select(*[F.col(g).alias(f"__g_{g}") for g in group], "ordinal")
    n = ordinals.agg(F.count("*")).scalar()
    on = [df[g].eqNullSafe(ordinals[f"__g_{g}"]) for g in group]
    out = df.join(ordinals, on).drop(*[f"__g_{g}" for g in group])
    cutoff = F.least(F.greatest(F.floor(n * F.lit(1.0 - share)), F.lit(1)), n - 1)
    return out.withColumn("role", F.when(F.col("ordinal") >= cutoff, "test").otherwise("train"))


def last_dates(df: DataFrame, date: str, n: int) -> DataFrame:
    """Rows of the last ``n`` distinct dates."""
    newest = df.select(F.col(date).alias("__d")).where(F.col("__d").isNotNull()).distinct().orderBy(F.desc("__d")).limit(n)
    return df.join(newest, df[date] == newest["__d"], "left_semi")


def last_groups(df: DataFrame, group: Sequence[str], n: int) -> DataFrame:
    """Rows of the last ``n`` groups in canonical order."""
    newest = group_ordinal(df, group).orderBy(F.desc("ordinal")).limit(n)
    return df.join(newest, list(group), "left_semi")


def recency_weight(date: Column, newest: Column, half_life_days: float, low: float = 0.2, high: float = 1.0) -> Column:
    """Half-life decay by age in days, kept inside ``[low, high]``."""
    age = F.datediff(newest, date)
    decay = F.exp(F.lit(-math.log(2.0) / half_life_days) * age)
    return F.least(F.greatest(decay, F.lit(low)), F.lit(high))


def normalized_recency(df: DataFrame, date: str, half_life_days: float, into: str = "weight") -> DataFrame:
    """Decay weights scaled to mean 1; a row without a date takes the median age."""
    from skyledger.operators.quantiles import grouped_quantiles

    newest = df.agg(F.max(date)).scalar()
    aged = df.withColumn("__newest", newest).withColumn("__age", F.datediff("__newest", date).cast("double"))
    median = grouped_quantiles(aged, [], "__age", {"m": 0.5}).select("m").scalar()
    raw = F.exp(F.lit(-math.log(2.0) / half_life_days) * F.coalesce("__age", "__m"))
    out = aged.withColumn("__m", median).withColumn("__w", raw)
    mean = out.agg(F.avg("__w")).scalar()
    return out.withColumn("__mean", mean).withColumn(into, F.col("__w") / F.col("__mean")).drop(
        "__newest", "__age", "__m", "__w", "__mean"
    )
