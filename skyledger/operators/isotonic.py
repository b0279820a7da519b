"""Isotonic calibration of outcome probabilities, for labels of any size.

The fitted value of a point is the slope of the greatest convex line under the cumulated hits against cumulated weights.
So the work can be cut: neighbouring violators may be pooled anywhere and in any order, and for any slope t the
point where (hits - t * weight) is least lies on that line, whatever is on its other side. Each round pools along ranges of the
points, then finds such points for some slopes from one row a range and slope, and cuts the labels there; what is
between two cuts is pooled by itself. Slopes are multiples of 2^-20 and sums are whole numbers, so cuts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.operators.asof import ordered_join
from skyledger.operators.expanding import arrow_rows
from skyledger.operators.quantiles import value_slice
from skyledger.session import written

#: Blocks that one task should pool in the end; more are cut again, at most ROUNDS times.
PART_BLOCKS = 1 << 17
ROUNDS = 6
#: Slopes are multiples of this.
SLOPE_STEP = 2.0**-20
BLOCKS = "label string, segment long, x_low double, x_high double, weight double, total double"
COLUMNS = ["x_low", "x_high", "weight", "total"]


def pool(low: np.ndarray, high: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pool neighbours that do not rise, run by run, until all rise.

    Means are compared by products of whole numbers, which are exact. Runs that shrink by little at a time are
    finished one after another.
    """
    for _ in range(64):
        falls = total[:-1] * weight[1:] >= total[1:] * weight[:-1]
        if not falls.any():
            return low, high, weight, total
        heads = np.concatenate(([0], np.flatnonzero(~falls) + 1))
        last = np.concatenate((heads[1:] - 1, [len(low) - 1]))
        low, high = low[heads], high[last]
        weight, total = np.add.reduceat(weight, heads), np.add.reduceat(total, heads)
    stack: list[list[float]] = []
    for block in zip(low.tolist(), high.tolist(), weight.tolist(), total.tolist()):
        stack.append(list(block))
        while len(stack) > 1 and stack[-2][3] * stack[-1][2] >= stack[-1][3] * stack[-2][2]:
            b = stack.pop()
            stack[-1] = [stack[-1][0], b[1], stack[-1][2] + b[2], stack[-1][3] + b[3]]
    return tuple(np.array(column) for column in zip(*stack))


def pooled_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pool rows that come sorted by label and x; only the blocks of the current label and segment are held."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        new = (batch["label"] != batch["label"].shift()) | (batch["segment"] != batch["segment"].shift())
        for _, own in batch.groupby(new.cumsum(), sort=False):
            key = own["label"].iloc[0], own["segment"].iloc[0]
            columns = [own[c].to_numpy() for c in COLUMNS]
            if held is not None and held[0] == key:
                columns = [np.concatenate(pair) for pair in zip(held[1], columns)]
            elif held is not None:
                yield block_frame(*held)
            held = key, pool(*columns)
    if held is not None:
        yield block_frame(*held)


def block_frame(key: tuple, columns: tuple[np.ndarray, ...]) -> pd.DataFrame:
    out = pd.DataFrame(dict(zip(COLUMNS, columns, strict=True)))
    out.insert(0, "segment", key[1])
    out.insert(0, "label", key[0])
    return out


def cut_points(blocks: DataFrame, part_blocks: int) -> DataFrame:
    """``label, cuts``: cumulated weights at which the line bends, for slopes that divide a label's blocks evenly."""
    sums = blocks.groupBy("label", "part").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"))
    before = Window.partitionBy("label").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("label", "part", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"{c}_before") for c in ("weight", "total")])
    sizes = blocks.groupBy("label").agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0]
    n = max(2, 4 * -(-most // part_blocks))
    shares = [i / n for i in range(1, n)]
    slopes = blocks.groupBy("label").agg(F.percentile_approx(F.col("total") / F.col("weight"), shares, 100 * n).alias("slopes"))
    asked = written(starts.join(sizes.where(F.col("n") > part_blocks), "label").join(slopes, "label").drop("n"), "isotonic-slopes")
    schema = "label string, slope double, value double, at double"

    def lowest(own: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows or not own.num_rows:
            return arrow_rows(schema, label=[], slope=[], value=[], at=[])
        one = asked.to_pylist()[0]
        order = np.argsort(own["x_low"].to_numpy(), kind="stable")
        weight, total = own["weight"].to_numpy()[order], own["total"].to_numpy()[order]
        w = one["weight_before"] + np.concatenate(([0.0], np.cumsum(weight)))
        s = one["total_before"] + np.concatenate(([0.0], np.cumsum(total)))
        slopes = np.unique(np.round(np.array(one["slopes"]) / SLOPE_STEP) * SLOPE_STEP)
        # the means of a range rise, so its lowest point for a slope is where they pass it
        at = np.searchsorted(total / weight, slopes, side="right")
        return arrow_rows(schema, label=[one["label"]] * len(slopes), slope=slopes, value=s[at] - slopes * w[at], at=w[at])

    found = blocks.groupBy("label", "part").cogroup(asked.groupBy("label", "part")).applyInArrow(lowest, schema)
    # the last of equally low points: the end of a straight piece
    points = found.groupBy("label", "slope").agg(F.max_by("at", F.struct((-F.col("value")).alias("v"), "at")).alias("at"))
    cuts = points.groupBy("label").agg(F.collect_set("at").alias("cuts"))
    return starts.join(cuts, "label")


def isotonic_blocks(points: DataFrame, part_blocks: int = PART_BLOCKS) -> DataFrame:
    """Rising blocks of ``label, x, weight, total`` (a row per label and x): ``label, x_low, x_high, weight, mean``."""
    spark = points.sparkSession
    blocks = points.select("label", F.lit(0).cast("long").alias("segment"), F.col("x").alias("x_low"), F.col("x").alias("x_high"), F.col("weight").cast("double"), F.col("total").cast("double"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for turn in range(ROUNDS):
        # other borders each time, so that no violating neighbours stay apart
        dealt = blocks.withColumn("segment", F.lit(0).cast("long")).repartitionByRange(parts + turn, "label", "x_low")
        dealt = dealt.withColumn("part", F.spark_partition_id())
        dealt = dealt.sortWithinPartitions("label", "x_low")
        pooled = dealt.mapInPandas(with_part, BLOCKS + ", part int")
        blocks = written(pooled, "isotonic")
        facts = blocks.groupBy("label", "segment").agg(F.count("*").alias("n"))
        most = facts.agg(F.max("n")).first()[0]
        if most is None or most <= part_blocks:
            break
        cuts = cut_points(blocks, part_blocks)
        upto = Window.partitionBy("label", "part").orderBy("x_low").rowsBetween(Window.unboundedPreceding, -1)
        start = F.col("weight_before") + F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
        placed = blocks.join(cuts, ["label", "part"], "left").withColumn("start", start)
        segment = F.when(F.col("cuts").isNotNull(), F.size(F.filter("cuts", lambda c: c <= F.col("start")))).otherwise(0)
        blocks = written(placed.select("label", segment.cast("long").alias("segment"), *COLUMNS), "isotonic-cut")
        if blocks.groupBy("label", "segment").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] <= part_blocks:
            break
    last = blocks.select("label", "segment", *COLUMNS).repartition("label", "segment").sortWithinPartitions("label", "segment", "x_low")
    return last.mapInPandas(pooled_rows, BLOCKS).select("label", "x_low", "x_high", "weight", (F.col("total") / F.col("weight")).alias("mean"))


def with_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``pooled_rows`` of one range, its blocks marked with the range."""
    part = None

    def seen():
        nonlocal part
        for batch in batches:
            part = int(batch["part"].iloc[0]) if len(batch) else part
            yield batch

    for out in pooled_rows(seen()):
        out["part"] = part
        yield out


def fit_isotonic(
    df: DataFrame, label: str, prob: str, hit: str, decision: Sequence[str] = (), min_rows: int = 10, min_winners: int = 2, part_blocks: int = PART_BLOCKS
) -> DataFrame:
    """Isotonic blocks per label (label, x_low, x_high, weight, mean).

    Whether there is a calibration at all is decided once: with fewer than ``min_rows`` decisions or ``min_winners``
    different winning labels there are no blocks. A label that a decision doesn't offer counts there with
    probability 0 and no hit. ``decision`` names the columns that tell decisions apart; without them the label with most
    rows counts them. Rows without a probability are left out; a missing hit is none.
    """
    rows = df.where(F.col(prob).isNotNull() & F.col(label).isNotNull())
    hits = F.sum(F.when(F.col(hit).cast("double") > 0, 1).otherwise(0))
    points = rows.groupBy(F.col(label).cast("string").alias("label"), F.col(prob).cast("double").alias("x")).agg(F.count("*").alias("weight"), hits.alias("total"))
    points = written(points, "isotonic-points")
    sizes = points.groupBy("label").agg(F.sum("weight").alias("n"), F.sum("total").alias("won"))
    facts = sizes.agg(F.max("n").alias("n"), F.count(F.when(F.col("won") > 0, 1)).alias("winners")).first()
    decisions = rows.select(*decision).distinct().count() if decision else facts["n"] or 0
    if decisions < min_rows or facts["winners"] < min_winners:
        return isotonic_blocks(points.where(F.lit(False)), part_blocks)
    absent = sizes.select("label", F.lit(0.0).alias("x"), (F.lit(decisions) - F.col("n")).alias("weight"), F.lit(0).cast("long").alias("total")).where("weight > 0")
    points = points.unionByName(absent).groupBy("label", "x").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"))
    return isotonic_blocks(points, part_blocks)


def apply_isotonic(df: DataFrame, blocks: DataFrame, label: str, prob: str, into: str = "calibrated") -> DataFrame:
    """Calibrate probabilities: a block's value inside it, a straight line between
    blocks, the end values outside; a label without a model keeps its value."""
    after = Window.partitionBy("label").orderBy("x_low")
    b = blocks.withColumn("x_next", F.lead("x_low").over(after)).withColumn("mean_next", F.lead("mean").over(after))
    b = b.withColumnRenamed("label", label)
    lowest = b.groupBy(label).agg(F.min("mean").alias("__first"))
    # Each distinct probability is looked up once, however many rows share it.
    points = df.select(label, F.col(prob).cast("double").alias("__p")).distinct()
    hit = ordered_join(
        points, b, [label], F.col("__p"), F.col("x_low"), lambda at: value_slice(at, 64),
        ["x_high", "mean", "x_next", "mean_next"], position_as="__at",
    ).join(lowest, label, "left")
    p = F.col("__p")
    line = F.col("mean") + (F.col("mean_next") - F.col("mean")) * (p - F.col("x_high")) / (F.col("x_next") - F.col("x_high"))
    inside = F.when((p <= F.col("x_high")) | F.col("x_next").isNull(), F.col("mean")).otherwise(line)
    value = F.when(F.col("__at").isNotNull(), inside).otherwise(F.coalesce("__first", "__p"))
    known = hit.select(label, "__p", value.alias(into))
    return df.withColumn("__p", F.col(prob).cast("double")).join(known, [label, "__p"], "left").drop("__p")
