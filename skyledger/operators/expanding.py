"""Expanding fits: every refit of a rolling back-test at once.

Refit r learns from the rows of blocks 0..r. What a fit needs is prepared per block, run over the blocks
by windows, and solved refit by refit in Arrow tasks; no table of sums passes the driver.

- A missing feature counts as the median of what refit r has seen. Sums are kept of the values with gaps as
  0, of the gap marks and of their products, so that any median can be put in afterwards.
- Running medians are order statistics of growing prefixes: values are cut into ever smaller ranges until the range that
  holds a wanted rank is small, then a weighted wavelet matrix answers all refits of a range together.
- Absolute residuals have no such sums: each row meets each later refit, where it lies if there are few refits, in blocks of rows
  and refits beyond that.

Sums are taken around the overall means, so that large values lose no digits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.session import written

MIN_STD = 0.5
#: Values of a range that one task answers; ranges are cut into PARTS.
RANGE_ROWS = 1 << 17
PARTS = 64
#: Refits and rows that meet in a task, and refits whose residuals are held at once.
REFITS = 512
ROWS = 1 << 16
TILE = 32
#: Numbers of products a task holds before it hands them on.
HELD = 1 << 22


def missing(value: Column) -> Column:
    return value.isNull() | F.isnan(value)


def solve(gram: np.ndarray, against: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Coefficients from centred sums of products; the least of all solutions where there are many."""
    if not len(gram):
        return np.zeros(0)
    scale = np.sqrt(np.maximum(np.diag(gram) + ridge, 1e-300))
    system = (gram + ridge * np.eye(len(gram))) / np.outer(scale, scale)
    return np.linalg.lstsq(system, against / scale, rcond=None)[0] / scale


# --- running medians -----------------------------------------------------------------------


def kth_smallest(values: np.ndarray, weights: np.ndarray, upto: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """For each query the value at a weighted rank (from 0) among the first ``upto`` values.

    A wavelet matrix: per bit of the values' order numbers, zeros go before ones; every query follows the side
    that holds its rank. All queries move together.
    """
    distinct, codes = np.unique(values, return_inverse=True)
    low, high, left = np.zeros(len(upto), dtype=np.int64), upto.astype(np.int64), ranks.astype(np.int64)
    found = np.zeros(len(upto), dtype=np.int64)
    for bit in range(max(1, int(len(distinct) - 1).bit_length()) - 1, -1, -1):
        one = (codes >> bit) & 1
        zeros = np.concatenate(([0], np.cumsum(1 - one)))
        weight = np.concatenate(([0], np.cumsum(weights * (1 - one))))
        below = weight[high] - weight[low]
        up = left >= below
        left = np.where(up, left - below, left)
        low, high = (np.where(up, zeros[-1] + at - zeros[at], zeros[at]) for at in (low, high))
        found |= up.astype(np.int64) << bit
        order = np.argsort(one, kind="stable")
        codes, weights = codes[order], weights[order]
    return distinct[found]


ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}


def arrow_rows(schema: str, **columns) -> pa.Table:
    """Columns as an Arrow table of a plain column list; tasks have no session to read it."""
    fields = [f.split() for f in schema.split(", ")]
    return pa.Table.from_pydict(columns, schema=pa.schema([(name, ARROW[kind]) for name, kind in fields]))


QUERY = "node string, feature int, refit int, share double, rank long"


def narrowed(values: DataFrame, queries: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut the given ranges into parts: values and queries of the parts that hold a wanted rank."""
    at = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS), F.lit(PARTS - 1)).cast("int")
    cut = values.join(nodes.select("node", "lo", "hi"), "node").withColumn("part", at)
    counts = cut.groupBy("node", "part", "block").agg(F.sum("n").alias("n"))

    def locate(found: pa.Table, wanted: pa.Table) -> pa.Table:
        refit = wanted["refit"].to_numpy()
        if not len(refit) or not found.num_rows:
            return arrow_rows(QUERY, node=[], feature=[], refit=[], share=[], rank=[])
        blocks, place = np.unique(found["block"].to_numpy(), return_inverse=True)
        grid = np.zeros((len(blocks) + 1, PARTS), dtype=np.int64)
        np.add.at(grid, (place + 1, found["part"].to_numpy()), found["n"].to_numpy())
        upto = np.cumsum(np.cumsum(grid, axis=0), axis=1)[np.searchsorted(blocks, refit, side="right")]
        rank = wanted["rank"].to_numpy()
        part = (upto <= rank[:, None]).sum(axis=1)
        before = np.where(part > 0, upto[np.arange(len(part)), np.maximum(part, 1) - 1], 0)
        return arrow_rows(
            QUERY, node=[f"{n}.{p}" for n, p in zip(wanted["node"].to_pylist(), part)], feature=wanted["feature"],
            refit=wanted["refit"], share=wanted["share"], rank=rank - before,
        )

    moved = queries.join(nodes.select("node"), "node", "left_semi").groupBy("node")
    child = counts.groupBy("node").cogroup(moved).applyInArrow(locate, QUERY)
    child = written(child, "median-queries")
    kept = cut.withColumn("node", F.concat_ws(".", "node", "part")).select("node", "block", "value", "n")
    return kept.join(child.select("node").distinct(), "node", "left_semi"), child


def running_medians(rows: DataFrame, features: Sequence[str], block: str, refits: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``refit, feature, median``: the exact median of each feature (by place) over the blocks up to each refit.

    Nulls and NaN do not count; refits that have seen no value get no row. Equal values of a block are one row
    with a count, so a value that most rows share costs nothing.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).cast("double").alias("value")) for i, f in enumerate(features)])
    long = rows.where(F.col(block) < refits).select(F.col(block).cast("int").alias("block"), F.inline(pairs)).where(~missing(F.col("value")))
    counts = written(long.groupBy("feature", "block", "value").agg(F.count("*").alias("n")), "median-counts")

    # how many values each refit has seen, for every refit
    grid = rows.sparkSession.range(refits).select(F.col("id").cast("int").alias("block"), F.explode(F.array(*[F.lit(i) for i in range(len(features))])).alias("feature"))
    seen = grid.join(counts.groupBy("feature", "block").agg(F.sum("n").alias("n")), ["feature", "block"], "left")
    upto = Window.partitionBy("feature").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = (F.coalesce(F.sum("n").over(upto), F.lit(0)) - 1) / 2.0
    wanted = seen.select("feature", F.col("block").alias("refit"), middle.alias("at")).where("at >= 0")
    ranks = F.array_distinct(F.array(F.floor("at"), F.ceil("at")))
    queries = wanted.select(
        F.col("feature").cast("string").alias("node"), "feature", "refit", (F.lit(1.0) / F.size(ranks)).alias("share"), F.explode(ranks).alias("rank")
    )

    values = counts.select(F.col("feature").cast("string").alias("node"), "block", "value", "n")
    settled = []
    while True:
        facts = values.groupBy("node").agg(F.count("*").alias("rows"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        facts = written(facts.withColumn("big", (F.col("rows") > range_rows) & (F.col("lo") < F.col("hi"))), "median-nodes")
        big = facts.where("big")
        small = facts.where("NOT big").select("node")
        settled.append((values.join(small, "node", "left_semi"), queries.join(small, "node", "left_semi")))
        if big.isEmpty():
            break
        values, queries = narrowed(values, queries, big)
        values = written(values, "median-values")

    schema = "refit int, feature int, part double"

    def answer(own: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows or not own.num_rows:
            return arrow_rows(schema, refit=[], feature=[], part=[])
        blocks = own["block"].to_numpy()
        order = np.argsort(blocks, kind="stable")
        upto = np.searchsorted(blocks[order], asked["refit"].to_numpy(), side="right")
        at = kth_smallest(own["value"].to_numpy()[order], own["n"].to_numpy()[order], upto, asked["rank"].to_numpy())
        return arrow_rows(schema, refit=asked["refit"], feature=asked["feature"], part=at * asked["share"].to_numpy())

    own, asked = (reduce(DataFrame.unionByName, side) for side in zip(*settled, strict=True))
    parts = own.groupBy("node").cogroup(asked.groupBy("node")).applyInArrow(answer, schema)
    return parts.groupBy("refit", "feature").agg(F.sum("part").alias("median"))


# --- running sums -----------------------------------------------------------------------------


def block_products(rows: DataFrame, features: Sequence[str], y: str, block: str, centre: np.ndarray, weight: str | None = None) -> DataFrame:
    """``block, pos, value``: weighted sums of products of (1, values, gap marks, target) per block.

    ``pos`` counts the upper triangle by rows. Rows without a target or weight count as nothing.
    """
    p = len(features)
    k = 2 * p + 2
    upper = np.triu_indices(k)
    schema = "block int, pos int, value double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for b, sums in held.items():
                n = len(upper[0])
                yield from arrow_rows(schema, block=np.full(n, b, dtype=np.int32), pos=np.arange(n, dtype=np.int32), value=sums[upper]).to_batches()
            held.clear()

        for batch in batches:
            z, blocks, w = design(batch, features, y, block, centre, weight)
            for b in np.unique(blocks):
                own = z[blocks == b]
                held[int(b)] = held.get(int(b), 0.0) + (own * w[blocks == b, None]).T @ own
            if len(held) * k * k > HELD:
                yield from out()
        yield from out()

    return rows.select(*needed(block, y, features, weight)).mapInArrow(run, schema)


def needed(block: str, y: str, features: Sequence[str], weight: str | None) -> list[str]:
    return list(dict.fromkeys([block, y, *features, *([weight] if weight else [])]))


def design(
    batch: pa.RecordBatch, features: Sequence[str], y: str, block: str, centre: np.ndarray, weight: str | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (1, values, gap marks, target) around the centre, all 0 without a target, their blocks and weights."""
    target = as_floats(batch[y])
    x = np.column_stack([np.ones((len(target), 0)), *[as_floats(batch[f]) for f in features]])
    gap = np.isnan(x)
    z = np.column_stack([np.ones(len(target)), np.where(gap, 0.0, x - centre[:-1]), gap, target - centre[-1]])
    z[np.isnan(target)] = 0.0
    w = np.nan_to_num(as_floats(batch[weight])) if weight else np.ones(len(target))
    return z, batch[block].to_numpy(zero_copy_only=False), w


def as_floats(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def as_array(df: DataFrame, key: str, value: str, into: str) -> DataFrame:
    """``key`` and its values by ``pos`` as one array of known length."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v"))))
    return df.groupBy(key).agg(F.transform(ordered, lambda s: s["v"]).alias(into))


FIT = "refit int, medians array<double>, mean array<double>, centre array<double>, gram array<double>, weight double"


def mean_fits(
    sums: DataFrame, medians: DataFrame, features: Sequence[str], centre: np.ndarray, refits: int, ridge: float, maps: DataFrame | None = None
) -> DataFrame:
    """Solve the mean of each refit from its running sums and medians; keeps its centred sums for the spread.

    ``maps`` (``refit, map``: a square matrix by rows) gives each refit linear combinations of the features, whose
    coefficients the ridge acts on. A refit that has seen no target gets no row.
    """
    p = len(features)
    upto = Window.partitionBy("pos").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a block without rows still has a refit
    spark, n_pos = sums.sparkSession, (2 * p + 2) * (2 * p + 3) // 2
    every = spark.range(refits).select(F.col("id").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_pos - 1))).alias("pos"), F.lit(0.0).alias("value"))
    whole = sums.unionByName(every).groupBy("block", "pos").agg(F.sum("value").alias("value"))
    running = whole.withColumn("upto", F.sum("value").over(upto))
    stats = as_array(running, "block", "upto", "sums").withColumnRenamed("block", "refit")
    by_place = F.map_from_entries(F.collect_list(F.struct("feature", "median")))
    joined = stats.join(medians.groupBy("refit").agg(by_place.alias("by_place")), "refit", "left")
    places = F.array(*[F.lit(i) for i in range(p)]).cast("array<int>")
    filled = F.transform(places, lambda i: F.coalesce(F.element_at("by_place", i), F.lit(0.0)))
    if maps is not None:
        joined = joined.join(maps, "refit", "left")
    joined = joined.select("refit", "sums", (F.lit(None).cast("array<double>") if maps is None else F.col("map")).alias("map"), F.when(F.lit(p == 0), F.array().cast("array<double>")).otherwise(filled).alias("medians"))
    upper = np.triu_indices(2 * p + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"refit": [], "medians": [], "mean": [], "centre": [], "gram": [], "weight": []}
            for row in batch.to_pylist():
                gram = np.zeros((2 * p + 2, 2 * p + 2))
                gram[upper] = row["sums"]
                gram = gram + np.triu(gram, 1).T
                # (1, values, gaps, y) to (1, values with gaps filled, y)
                fill = np.zeros((p + 2, 2 * p + 2))
                fill[0, 0] = fill[-1, -1] = 1.0
                fill[1 : p + 1, 1 : p + 1] = np.eye(p)
                fill[1 : p + 1, p + 1 : -1] = np.diag(np.asarray(row["medians"]) - centre[:-1])
                full = fill @ gram @ fill.T
                n = full[0, 0]
                means = full[0] / max(n, 1.0)
                inner = full - n * np.outer(means, means)
                turn = np.eye(p) if row["map"] is None else np.asarray(row["map"]).reshape(p, p)
                beta = turn.T @ solve(turn @ inner[1:-1, 1:-1] @ turn.T, turn @ inner[1:-1, -1], ridge)
                out["refit"].append(row["refit"])
                out["medians"].append(row["medians"])
                # around the centre: value = start + beta * (x - centre)
                out["mean"].append([float(means[-1] + centre[-1] - means[1:-1] @ beta), *beta])
                out["centre"].append(means[1:-1])
                out["gram"].append(inner[1:-1, 1:-1].ravel())
                out["weight"].append(float(n))
            yield from arrow_rows(FIT, **out).to_batches()

    return joined.mapInArrow(run, FIT).where("weight > 0")


def residual_sums(
    rows: DataFrame,
    fits: DataFrame,
    features: Sequence[str],
    y: str,
    block: str,
    centre: np.ndarray,
    n_rows: int,
    refits: int,
    weight: str | None = None,
    clip: tuple[float, float] | None = None,
) -> DataFrame:
    """``refit, pos, value``: weighted sums of absolute residuals times (1, features), over all rows a refit has learned from."""
    p = len(features)
    last = (refits - 1) // REFITS
    usable = rows.where(~missing(F.col(y).cast("double")) & (F.col(block) < refits)).select(*needed(block, y, features, weight))
    schema = "refit int, pos int, value double"

    def residuals(batch: pa.RecordBatch, some: pa.Table) -> np.ndarray:
        z, blocks, w = design(batch, features, y, block, centre, weight)
        values, gaps, target = z[:, 1 : p + 1], z[:, p + 1 : -1], z[:, -1]
        refit = some["refit"].to_numpy()
        mean = np.array(some["mean"].to_pylist())
        filled = np.array(some["medians"].to_pylist()).reshape(len(refit), p) - centre[:-1]
        parts = []
        for i in range(0, len(refit), TILE):
            at = slice(i, i + TILE)
            predicted = mean[at, 0] - centre[-1] + values @ mean[at, 1:].T + gaps @ (filled[at] * mean[at, 1:]).T
            off = np.abs(target[:, None] - predicted)
            off = (off if clip is None else np.clip(off, *clip)) * w[:, None]
            off[blocks[:, None] > refit[at]] = 0.0
            parts.append(np.column_stack([off.sum(axis=0), off.T @ values + (off.T @ gaps) * filled[at]]))
        return np.concatenate(parts)

    def by_place(some: pa.Table, sums: np.ndarray) -> pa.Table:
        refit = some["refit"].to_numpy()
        return arrow_rows(schema, refit=np.repeat(refit, p + 1), pos=np.tile(np.arange(p + 1, dtype=np.int32), len(refit)), value=sums.ravel())

    if last <= 0:  # at most REFITS fits: they go to all tasks, and no row moves
        few = fits.select("refit", "medians", "mean").toArrow()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for i in range(0, batch.num_rows if few.num_rows else 0, ROWS):
                    own = residuals(batch.slice(i, ROWS), few)
                    total = own if total is None else total + own
            if total is not None:
                yield from by_place(few, total).to_batches()

        return usable.mapInArrow(add, schema)

    salts = max(1, -(-n_rows // ROWS))
    left = usable.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    left = left.withColumn("__chunk", F.explode(F.sequence((F.col(block) / REFITS).cast("int"), F.lit(last))))
    right = fits.select("refit", "medians", "mean", F.floor(F.col("refit") / REFITS).cast("int").alias("__chunk"))
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("__salt", F.col("__salt").cast("long"))

    def run(own: pa.Table, some: pa.Table) -> pa.Table:
        if not own.num_rows or not some.num_rows:
            return arrow_rows(schema, refit=[], pos=[], value=[])
        return by_place(some, residuals(own.combine_chunks().to_batches()[0], some))

    return left.groupBy("__chunk", "__salt").cogroup(right.groupBy("__chunk", "__salt")).applyInArrow(run, schema)


def spread_fits(
    fits: DataFrame, residuals: DataFrame, features: Sequence[str], centre: np.ndarray, ridge: float, spread_on: Sequence[str] | None = None
) -> DataFrame:
    """``refit, medians, mean, spread`` with intercepts for the features as they are; other features than ``spread_on`` get 0."""
    p = len(features)
    used = [i for i, f in enumerate(features) if spread_on is None or f in spread_on]
    sums = as_array(residuals.groupBy("refit", "pos").agg(F.sum("value").alias("value")), "refit", "value", "off")
    schema = "refit int, medians array<double>, mean array<double>, spread array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"refit": [], "medians": [], "mean": [], "spread": []}
            for row in batch.to_pylist():
                off, n = np.asarray(row["off"] or np.zeros(p + 1)), row["weight"]
                means, gram = np.asarray(row["centre"]), np.asarray(row["gram"]).reshape(p, p)
                beta = np.zeros(p)
                beta[used] = solve(gram[np.ix_(used, used)], (off[1:] - means * off[0])[used], ridge)
                spread = [float((off[0] / n if n else 0.0) - means @ beta), *beta]
                out["refit"].append(row["refit"])
                out["medians"].append(row["medians"])
                for name, fit in (("mean", row["mean"]), ("spread", spread)):
                    out[name].append([fit[0] - float(centre[:-1] @ np.asarray(fit[1:])), *fit[1:]])
            yield from arrow_rows(schema, **out).to_batches()

    return fits.join(sums, "refit", "left").mapInArrow(run, schema)


@dataclass
class ExpandingFits:
    """One row per refit: medians, mean and spread coefficients (intercept first)."""

    features: list[str]
    table: DataFrame

    def score(
        self, df: DataFrame, refit: str = "refit", mean: str = "pred_mean", std: str = "pred_std", clip: tuple[float, float | None] = (MIN_STD, None)
    ) -> DataFrame:
        """Predict each row with its refit; a missing feature counts as that refit's median.

        Rows of a refit that has learned from nothing stay, without a prediction.
        """
        fits = self.table.select(F.col("refit").alias(refit), F.col("medians").alias("__f"), F.col("mean").alias("__m"), F.col("spread").alias("__s"))
        value = {f: F.col(f).cast("double") for f in self.features}
        filled = [F.when(missing(value[f]), F.get("__f", F.lit(i))).otherwise(value[f]) for i, f in enumerate(self.features)]

        def dot(side: str) -> Column:
            return reduce(lambda a, b: a + b, [F.get(side, F.lit(i + 1)) * x for i, x in enumerate(filled)], F.get(side, F.lit(0)))

        spread = F.greatest(dot("__s"), F.lit(clip[0]))
        spread = spread if clip[1] is None else F.least(spread, F.lit(clip[1]))
        joined = df.join(fits, refit, "left").withColumns({mean: dot("__m"), std: F.when(F.col("__s").isNotNull(), spread)})
        return joined.drop("__f", "__m", "__s")


def expanding_gaussian(
    df: DataFrame,
    features: Sequence[str],
    y: str,
    block: str,
    ridge: float = 0.0,
    weight: str | None = None,
    clip: tuple[float, float] | None = None,
    spread_on: Sequence[str] | None = None,
    maps: DataFrame | None = None,
    whole: bool = False,
) -> ExpandingFits:
    """Fit r uses the rows of blocks 0..r, for every r below the last block (``whole``: the last one too, so all rows).

    Mean by least squares (ridge on raw coefficients, none on the intercept), spread by least squares of the
    absolute residuals, held inside ``clip``. Missing features (null or NaN) count as the median of all that refit has seen, 0
    where it has seen none; rows without a target are left out. Without features the fits are means.
    ``spread_on`` are the features of the spread if not all; ``maps`` see ``mean_fits``.
    ``df`` is read several times and should be a written table. An empty table gives no fit.
    """
    features = list(features)
    target = F.col(y).cast("double")
    has = ~missing(target)
    value = [F.col(f).cast("double") for f in features]
    centres = [F.avg(F.when(has & ~missing(v), v)) for v in value]
    facts = df.agg(F.max(block), F.count("*"), *centres, F.avg(F.when(has, target))).first()
    refits = 0 if facts[0] is None else int(facts[0]) + int(whole)
    centre = np.array([float(v or 0.0) for v in facts[2:]])
    rows = df.where(F.col(block) < refits)
    medians = running_medians(rows.where(has), features, block, refits) if features else df.sparkSession.createDataFrame([], "refit int, feature int, median double")
    sums = block_products(rows, features, y, block, centre, weight)
    # written: the mean fits are read with every row block and once more for the spread
    fits = written(mean_fits(sums, medians, features, centre, refits, ridge, maps), "mean-fits")
    residuals = residual_sums(rows, fits, features, y, block, centre, int(facts[1]), refits, weight, clip)
    return ExpandingFits(features, written(spread_fits(fits, residuals, features, centre, ridge, spread_on), "spread-fits"))


def degree_two_maps(df: DataFrame, base: Sequence[str], block: str, whole: bool = False) -> DataFrame:
    """``refit, map`` from raw terms (each feature, then all products of two) to those of features that a refit standardizes.

    Means and deviations are those of the blocks up to the refit. Constants are left to the intercept. ``df`` has no gaps.
    """
    p = len(base)
    value = [F.col(f).cast("double") for f in base]
    sums = df.groupBy(F.col(block).alias("refit")).agg(F.count("*").cast("double").alias("n"), F.array(*[F.sum(v) for v in value]).alias("s"), F.array(*[F.sum(v * v) for v in value]).alias("q"))
    upto = Window.orderBy("refit").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a block
    last = df.agg(F.max(block)).first()[0]
    refits = 0 if last is None else int(last) + int(whole)
    every = df.sparkSession.range(refits).select(F.col("id").cast("int").alias("refit")).join(sums, "refit", "left")
    total = lambda a, i: F.coalesce(F.sum(F.get(a, F.lit(i))).over(upto), F.lit(0.0))
    running = every.select("refit", F.sum("n").over(upto).alias("n"), F.array(*[total("s", i) for i in range(p)]).alias("s"), F.array(*[total("q", i) for i in range(p)]).alias("q"))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    schema = "refit int, map array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refit, maps = [], []
            for row in batch.to_pylist():
                n = row["n"] or 1.0
                mean = np.asarray(row["s"]) / n
                scale = np.sqrt(np.maximum(np.asarray(row["q"]) / n - mean * mean, 0.0))
                scale[scale <= 1e-12 * np.maximum(np.abs(mean), 1.0)] = 1.0
                out = np.zeros((p + len(pairs), p + len(pairs)))
                out[range(p), range(p)] = 1.0 / scale
                for k, (i, j) in enumerate(pairs):
                    size = scale[i] * scale[j]
                    out[p + k, p + k] = 1.0 / size
                    out[p + k, i] -= mean[j] / size
                    out[p + k, j] -= mean[i] / size
                refit.append(row["refit"])
                maps.append(out.ravel())
            yield from arrow_rows(schema, refit=refit, map=maps).to_batches()

    return running.mapInArrow(run, schema)
