"""Time-ordered operators over keyed ticks, safe for keys of any size.

A plain window per key would send a hot key to one task. Each operator here
cuts time into slices, works inside (key, slice), and carries one summary row
per (key, slice) forward. The carried rows join the same window as ordinary
rows, so the large side is shuffled once and nothing is joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.session import written

MICROS = 1_000_000
#: Rows of a (key, slice) beyond which it is cut further, sampled rows that tell, parts of a cut slice.
SLICE_ROWS = 4_000_000
SAMPLED = 200
SLICE_PARTS = 64
#: Cut slices that are sent to all tasks; more are joined as Spark sees fit.
BROADCAST_SLICES = 20_000


def source_bytes(df: DataFrame) -> int:
    """Size of what a frame is read from, as far as Spark knows it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def cut_hot_slices(frames: Sequence[DataFrame], keys: Sequence[str], slice_rows: int) -> list[DataFrame]:
    """Cut the slices that hold too many rows at quantiles of their own positions.

    Frames have ``keys``, ``__slice`` and ``__at``; a cut slice becomes up to 64 of about equal depth, in order. A sample
    finds them, so which slices are cut may differ by chance, but never what comes of them: any cut
    of the axis gives the same result. Frames made from less than ``slice_rows`` bytes are not sampled. Rows of
    one position stay together.
    """
    if sum(map(source_bytes, frames)) < slice_rows:
        return list(frames)
    at = reduce(DataFrame.unionByName, [f.select(*keys, "__slice", "__at") for f in frames])
    sample = at.where(F.col("__at").isNotNull()).sample(min(1.0, SAMPLED / slice_rows), seed=7)
    shares = [i / SLICE_PARTS for i in range(1, SLICE_PARTS)]
    found = sample.groupBy(*keys, "__slice").agg(F.count("*").alias("__n"), F.percentile_approx("__at", shares, 4 * SLICE_PARTS).alias("__cuts"))
    hot = written(found.where(F.col("__n") >= min(SAMPLED, slice_rows)).select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.col("__slice").alias("__h"), "__cuts"), "hot-slices")
    n = hot.count()
    if not n:
        return list(frames)
    side = F.broadcast(hot) if n <= BROADCAST_SLICES else hot
    part = F.coalesce(F.size(F.filter(F.array_distinct("__cuts"), lambda c: c <= F.col("__at"))), F.lit(0))
    out = []
    for f in frames:
        on = reduce(lambda a, b: a & b, [f[k].eqNullSafe(side[f"__h_{k}"]) for k in keys] + [f["__slice"] == side["__h"]])
        cut = f.join(side, on, "left").withColumn("__slice", F.struct(F.col("__slice").alias("s"), F.when(F.col("__cuts").isNotNull(), part).otherwise(0).alias("p")))
        out.append(cut.drop("__h", "__cuts", *[f"__h_{k}" for k in keys]))
    return out


def time_slice(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * MICROS))


def ordered_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_order: Column,
    right_order: Column,
    slice_of: Callable[[Column], Column],
    right_columns: Sequence[str],
    sequence: Column | None = None,
    position_as: str = "matched_at",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Attach to each left row the last right row at or before it on one axis.

    ``slice_of`` maps the axis to slices in the same order; slices of more than ``slice_rows`` rows are cut
    further. Right rows without a position never match; equal positions match; ``sequence`` breaks ties (the
    highest wins).
    """
    keys = list(keys)
    kept = [c for c in left.columns if c not in keys]
    seq = (F.lit(0) if sequence is None else sequence).cast("bigint")
    right_rows = right.where(right_order.isNotNull()).select(
        *keys,
        right_order.alias("__at"),
        F.lit(0).alias("__late"),
        seq.alias("__seq"),
        F.struct(right_order.alias("__at"), *[F.col(c) for c in right_columns]).alias("__right"),
    )
    left_rows = left.select(
        *keys,
        left_order.alias("__at"),
        F.lit(1).alias("__late"),
        F.lit(0).cast("bigint").alias("__seq"),
        F.struct(F.lit(1).alias("__row"), *[F.col(c) for c in kept]).alias("__left"),
    )
    right_rows = right_rows.withColumn("__slice", slice_of(F.col("__at")))
    left_rows = left_rows.withColumn("__slice", slice_of(F.col("__at")))
    right_rows, left_rows = cut_hot_slices([right_rows, left_rows], keys, slice_rows)

    # Last right row of every (key, slice), carried to the next slices of the key.
    closing = right_rows.groupBy(*keys, "__slice").agg(F.max_by("__right", F.struct("__at", "__seq")).alias("__close"))
    visited = left_rows.select(*keys, "__slice").distinct()
    slices = closing.unionByName(visited, allowMissingColumns=True).groupBy(*keys, "__slice").agg(
        F.first("__close", ignorenulls=True).alias("__close")
    )
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        slices.withColumn("__right", F.last("__close", ignorenulls=True).over(before))
        .where(F.col("__right").isNotNull())
        .select(*keys, F.col("__right.__at").alias("__at"), F.lit(0).alias("__late"),
                F.lit(0).cast("bigint").alias("__seq"), "__right", "__slice")
    )
    inside = (
        Window.partitionBy(*keys, "__slice")
        .orderBy("__at", "__late", "__seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    matched = (
        right_rows.unionByName(left_rows, allowMissingColumns=True)
        .unionByName(carried, allowMissingColumns=True)
        .withColumn("__hit", F.last("__right", ignorenulls=True).over(inside))
        .where(F.col("__late") == 1)
    )
    return matched.select(
        *keys,
        *[F.col(f"__left.{c}").alias(c) for c in kept],
        *[F.col(f"__hit.{c}").alias(c) for c in right_columns],
        F.col("__hit.__at").alias(position_as),
    )


def asof_join(
    decisions: DataFrame,
    ticks: DataFrame,
    keys: Sequence[str],
    decision_time: str,
    tick_time: str,
    tick_columns: Sequence[str],
    sequence: str | None = None,
    slice_seconds: int = 86_400,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Attach the latest tick at or before each decision (backward as-of).

    A tick with a null price does match and hides older ones. Result: the
    decision columns, the tick columns and ``matched_time``, null where nothing
    matched.
    """
    return ordered_join(
        decisions,
        ticks,
        keys,
        F.col(decision_time).cast("timestamp"),
        F.col(tick_time).cast("timestamp"),
        lambda at: time_slice(at, slice_seconds),
        tick_columns,
        F.col(sequence) if sequence else None,
        "matched_time",
        slice_rows,
    )


def price_panel(
    decisions: DataFrame,
    ticks: DataFrame,
    keys: Sequence[str],
    decision_time: str = "decision_time_utc",
    tick_time: str = "timestamp",
    price: str = "price",
    max_age_minutes: float = 720.0,
    extra_columns: Sequence[str] = (),
    sequence: str | None = None,
    slice_seconds: int = 86_400,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """As-of price panel: price, its time and age, and ok / stale / missing.

    Age is inclusive at the limit. Where the latest tick has no price the row
    is missing and carries neither price nor age. Rows without a decision time
    are dropped.
    """
    usable = decisions.where(F.col(decision_time).isNotNull())
    joined = asof_join(usable, ticks, keys, decision_time, tick_time, [price, *extra_columns], sequence, slice_seconds, slice_rows)
    has_price = F.col(price).isNotNull()
    age = (F.unix_micros(F.col(decision_time).cast("timestamp")) - F.unix_micros("matched_time")) / F.lit(float(MICROS))
    out = (
        joined.withColumn("price_age_seconds", F.when(has_price, age))
        .withColumn("price_ts", F.when(has_price, F.col("matched_time")))
        .withColumn(
            "coverage_status",
            F.when(~has_price, "missing")
            .when(F.col("price_age_seconds") <= max_age_minutes * 60.0, "ok")
            .otherwise("stale"),
        )
        .drop("matched_time")
    )
    return out.withColumnRenamed(price, "market_price")


def decision_tokens(decisions: DataFrame, labels: str, tokens: str, label_as: str = "outcome_label", token_as: str = "token_id") -> DataFrame:
    """One row per decision and (label, token); the longer list is cut to the shorter."""
    width = F.least(F.size(labels), F.size(tokens))
    zipped = F.arrays_zip(F.slice(labels, F.lit(1), width).alias(label_as), F.slice(tokens, F.lit(1), width).alias(token_as))
    rest = [c for c in decisions.columns if c not in (labels, tokens)]
    return decisions.where(width > 0).select(*rest, F.inline(zipped))


def latest_before(df: DataFrame, time_column: str, at: Column) -> DataFrame:
    """All rows that share the greatest time at or before ``at``."""
    eligible = df.where(F.col(time_column) <= at)
    return eligible.where(F.col(time_column) == eligible.agg(F.max(time_column)).scalar())


def latest_before_per_key(df: DataFrame, keys: Sequence[str], time_column: str, at: Column) -> DataFrame:
    """Per key, all rows sharing the greatest time at or before ``at``."""
    eligible = df.where(F.col(time_column) <= at)
    newest = eligible.groupBy(*keys).agg(F.max(time_column).alias("__max"))
    renamed = newest.select(*[F.col(k).alias(f"__r_{k}") for k in keys], "__max")
    on = reduce(lambda a, b: a & b, [eligible[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return eligible.join(renamed, on & (eligible[time_column] == renamed["__max"]), "left_semi")


def last_value(df: DataFrame, keys: Sequence[str], value: str, time_column: str, sequence: Sequence[str] = ()) -> DataFrame:
    """Last non-null value per key (null keys dropped), aggregated map-side."""
    order = F.struct(time_column, *sequence)
    return (
        df.where(F.col(value).isNotNull())
        .dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(F.max_by(value, order).alias(value), F.max(time_column).alias(time_column))
    )


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    time_column: str,
    value: str,
    into: str,
    sequence: Sequence[str] = (),
    slice_seconds: int = 86_400,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Running maximum per key up to and including each row."""
    keys = list(keys)
    rows = df.withColumn("__slice", time_slice(F.col(time_column), slice_seconds)).withColumn("__at", F.col(time_column))
    rows = cut_hot_slices([rows], keys, slice_rows)[0].drop("__at").withColumn("__real", F.lit(1))
    peaks = rows.groupBy(*keys, "__slice").agg(F.max(value).alias("__peak"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    opening = (
        peaks.withColumn("__open", F.max("__peak").over(before))
        .where(F.col("__open").isNotNull())
        .select(*keys, "__slice", F.col("__open").alias(value), F.lit(0).alias("__real"))
    )
    inside = (
        Window.partitionBy(*keys, "__slice")
        .orderBy("__real", time_column, *sequence)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.unionByName(opening, allowMissingColumns=True)
        .withColumn(into, F.max(value).over(inside))
        .where(F.col("__real") == 1)
        .drop("__slice", "__real")
    )


def stop_scan(
    ticks: DataFrame,
    keys: Sequence[str],
    time_column: str,
    price: str,
    entry_price: str,
    threshold: float = 0.20,
    sequence: Sequence[str] = (),
    slice_seconds: int = 86_400,
    opening_peak: str | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """First stop per position: loss of ``threshold`` of entry, else a fall of
    20 % from the peak once the price has been above entry. The loss rule is
    tested first, and the peak starts at the entry price or an earlier peak."""
    keys = list(keys)
    marked = running_max(ticks, keys, time_column, price, "__seen", sequence, slice_seconds, slice_rows)
    peak = F.greatest("__seen", entry_price, *([opening_peak] if opening_peak else []))
    loss = F.when(F.col(entry_price) > 0, (F.col(entry_price) - F.col(price)) / F.col(entry_price))
    drawdown = F.when(peak > 0, (peak - F.col(price)) / peak)
    reason = F.when(loss >= threshold, "stop_loss").when(
        (peak > F.col(entry_price)) & (drawdown >= 0.20), "trailing_stop"
    )
    hits = marked.withColumn("high_water_mark", peak).withColumn("exit_reason", reason)
    order = F.struct(time_column, *sequence)
    return (
        hits.where(F.col("exit_reason").isNotNull())
        .groupBy(*keys)
        .agg(
            F.min(time_column).alias("exit_time"),
            F.min_by("exit_reason", order).alias("exit_reason"),
            F.min_by(price, order).alias("exit_price"),
            F.min_by("high_water_mark", order).alias("high_water_mark"),
        )
    )
