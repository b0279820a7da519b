"""Boosted classifiers of growing training parts, learned together.

Folds in order of time train on nested parts of the rows: all rows before them. Here all their models are learned in common
passes. Bin limits come from sketches of each part, merged for every model. A row is coded once, by the limits of all models,
and rows of one part and code are one cell with the weights of both labels. Each level of each round of trees is one pass over
the cells, which adds up the sums that the splits of all models are chosen from.

Bins, loss, splits and leaves are those of ``boosting.fit_classifier``: each model learns from all of its rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.operators.boosting import BINS, binned, value_of
from skyledger.operators.expanding import arrow_rows
from skyledger.session import short_methods, written

#: Weighted values that a sketch ends with, and rows sorted at a time. A value in a sketch of a task of some million rows is
#: less than a thousandth of the rows off its rank, the error that ``boosting.bin_limits`` allows.
POINTS = 2048
SORTED_ROWS = 1 << 17
#: Cells of a block.
BLOCK = 8192
#: Bins of a feature and the one of missing values.
WIDTH = BINS + 1
STEP = 0.1


def runs(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and the weight of each."""
    if not len(values):
        return values, np.zeros(0)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.diff(np.append(first, len(values))).astype(float) if weights is None else np.add.reduceat(weights, first)


def thinned(values: np.ndarray, weights: np.ndarray, most: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """At most so many weighted values: those in the middle of as many equal shares of the weight."""
    if len(values) <= most:
        return values, weights
    upto = np.cumsum(weights)
    at = np.searchsorted(upto, (np.arange(most) + 0.5) * (upto[-1] / most))
    return runs(values[at], np.full(most, upto[-1] / most))


def merged(sketches: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    values, weights = (np.concatenate(x) for x in zip(*sketches))
    order = np.argsort(values, kind="stable")
    return runs(values[order], weights[order])


def limits_of(values: np.ndarray, weights: np.ndarray) -> list[float]:
    """Lower ends of the bins but the first, by the rule of ``boosting.bin_limits``."""
    if len(values) <= BINS:
        ends = values[1:]
    else:
        upto = np.cumsum(weights)
        at = np.searchsorted(upto, upto[-1] * np.arange(1, BINS) / BINS)
        ends = np.unique(values[np.minimum(at, len(values) - 1)])
    return [float(x) for x in ends if math.isfinite(x)]


def numbers(batch, name: str) -> np.ndarray:
    return batch[name].to_numpy(zero_copy_only=False)


def nested_limits(rows: DataFrame, width: int, upto: Sequence[int]) -> list[list[list[float]]]:
    """Bin limits by model and feature; model k learns from the parts up to ``upto[k]``.

    ``rows`` have part and features v0, v1... One pass; a feature's sketches are merged by one task.
    """
    names, schema = [f"v{i}" for i in range(width)], "feature int, part int, points binary, weights binary"

    def of_rows(batches):
        held, waiting = {}, []

        def settle():
            part = np.concatenate([numbers(b, "part") for b in waiting])
            order = np.argsort(part, kind="stable")
            ends = np.flatnonzero(np.append(np.diff(part[order]) != 0, True)) + 1
            for i, name in enumerate(names):
                column = np.concatenate([numbers(b, name) for b in waiting])[order]
                for start, end in zip([0, *ends[:-1]], ends):
                    values = np.sort(column[start:end])
                    key = i, int(part[order[start]])
                    found = thinned(*runs(values[: np.searchsorted(values, np.nan)]))
                    held[key] = merged([held[key], found]) if key in held else found
                    if len(held[key][0]) > 8 * POINTS:
                        held[key] = thinned(*held[key])
            waiting.clear()

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= SORTED_ROWS:
                settle()
        if any(b.num_rows for b in waiting):
            settle()
        found = [(i, p, *(np.ascontiguousarray(x, float).tobytes() for x in thinned(*s))) for (i, p), s in held.items()]
        if found:
            feature, part, points, weights = map(list, zip(*found))
            yield from arrow_rows(schema, feature=feature, part=part, points=points, weights=weights).to_batches()

    def of_feature(table):
        sketch = [[np.frombuffer(x) for x in pair] for pair in zip(table["points"].to_pylist(), table["weights"].to_pylist())]
        parts = table["part"].to_pylist()
        limits = [limits_of(*merged([s for s, p in zip(sketch, parts) if p <= last])) if min(parts) <= last else [] for last in upto]
        return arrow_rows(found, feature=[table["feature"][0].as_py()] * len(upto), model=[*range(len(upto))], limits=limits)

    found = "feature int, model int, limits array<double>"
    sketches = rows.select("part", *names).mapInArrow(of_rows, schema)
    limits = {(r["feature"], r["model"]): list(r["limits"]) for r in sketches.groupBy("feature").applyInArrow(of_feature, found).collect()}
    return [[limits.get((i, k), []) for i in range(width)] for k in range(len(upto))]


@dataclass
class Codes:
    """Codes of values by the limits of all models, and each model's bins as ranges of codes."""

    limits: list[list[list[float]]]

    def __post_init__(self):
        width = len(self.limits[0])
        self.cuts = [np.array(sorted({x for model in self.limits for x in model[i]}) or [0.0]) for i in range(width)]
        self.sizes = [len(c) + 2 for c in self.cuts]  # the last code is that of missing values
        self.kind = np.dtype("u1" if max(self.sizes) <= 256 else "<u2")
        #: First code of each bin, by model and feature; bins reach to the next one's.
        self.firsts = [[np.concatenate([[0], np.searchsorted(c, ends) + 1, [len(c) + 1]]).astype(int) for c, ends in zip(self.cuts, model)] for model in self.limits]


def cells(rows: DataFrame, codes: Codes) -> DataFrame:
    """Rows of one part and code as one cell with the weights of both labels, in blocks; codes of a block lie feature by feature."""
    width, size = len(codes.cuts), codes.kind.itemsize
    blocks = "part int, cells int, codes binary, won binary, lost binary"
    coded, bins = binned(rows, [f"v{i}" for i in range(width)], [c.tolist() for c in codes.cuts])
    # as many codes as fit into a long lie in one, the first in its lowest bytes
    per = 8 // size
    packed = [[F.shiftleft(F.col(b).cast("long"), 8 * size * i) for i, b in enumerate(bins[s : s + per])] for s in range(0, width, per)]
    keys = [f"k{i}" for i in range(len(packed))]
    coded = coded.select("part", "won", "lost", *[reduce(lambda a, b: a.bitwiseOR(b), word).alias(k) for k, word in zip(keys, packed)])

    def block(batches):
        waiting = {}

        def put(part, most):
            found, won, lost = (np.concatenate(x) for x in zip(*waiting.pop(part)))
            for s in range(0, len(won), BLOCK):
                if len(won) - s < most:
                    waiting[part] = [(found[s:], won[s:], lost[s:])]
                    return
                e = s + BLOCK
                yield from arrow_rows(blocks, part=[part], cells=[len(won[s:e])], codes=[found[s:e].T.tobytes()], won=[won[s:e].tobytes()], lost=[lost[s:e].tobytes()]).to_batches()

        for batch in batches:
            if batch.num_rows:
                of, won, lost = (numbers(batch, x) for x in ("part", "won", "lost"))
                found = np.ascontiguousarray(np.column_stack([numbers(batch, k) for k in keys]), "<i8").view(codes.kind)[:, :width]
                for part in np.unique(of):
                    own = of == part
                    waiting.setdefault(int(part), []).append((found[own], won[own], lost[own]))
                    if sum(len(x[1]) for x in waiting[int(part)]) >= BLOCK:
                        yield from put(int(part), BLOCK)
        for part in list(waiting):
            yield from put(part, 1)

    grouped = coded.groupBy("part", *keys).agg(F.sum("won").alias("won"), F.sum("lost").alias("lost"))
    with short_methods(rows.sparkSession):
        return written(grouped.mapInArrow(block, blocks), "cells")


@dataclass
class Tree:
    """Splits level by level, (feature, last bin to the left) or none where nothing is gained, and the leaves' values."""

    levels: list[list[tuple[int, int] | None]]
    values: np.ndarray

    def leaf(self, n: int, to_right: Callable[[int, int], np.ndarray]) -> np.ndarray:
        """Each row's place after the known levels; ``to_right`` tells which rows lie behind a feature's bin."""
        at = np.zeros(n, np.uint8)
        for splits in self.levels:
            right = np.zeros(n, bool)
            for node, split in enumerate(splits):
                if split:
                    right |= (at == node) & to_right(*split)
            at = at * np.uint8(2) + right
        return at


def grown(tree: Tree, sums: np.ndarray) -> Tree:
    """The tree with one more level, from the sums of weights and of weighted targets by node, feature and bin."""
    splits, values = [], []
    for node, (weight, target) in enumerate(np.moveaxis(sums, -1, 1)):
        total, aim = weight[0].sum(), target[0].sum()
        mean = aim / total if total > 0 else tree.values[node]
        left, right = (np.cumsum(x, 1)[:, :-1] for x in (weight, weight[:, ::-1]))
        left_aim, right_aim = (np.cumsum(x, 1)[:, :-1] for x in (target, target[:, ::-1]))
        right, right_aim = right[:, ::-1], right_aim[:, ::-1]
        split = (left > 0) & (right > 0)
        gain = np.full(left.shape, -np.inf)
        gain[split] = (left_aim[split] ** 2 / left[split] + right_aim[split] ** 2 / right[split] - aim * mean) / total
        best = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[best] > 0:
            splits.append((int(best[0]), int(best[1])))
            values += [left_aim[best] / left[best], right_aim[best] / right[best]]
        else:
            splits.append(None)
            values += [mean, mean]
    return Tree([*tree.levels, splits], np.array(values))


def level_sums(blocks: DataFrame, codes: Codes, upto: Sequence[int], done: Sequence[Sequence[Tree]], trees: Sequence[Tree]) -> dict[int, np.ndarray]:
    """Sums that the next level of every model's tree is chosen from, by node, feature and bin: one pass over the cells.

    Tasks add up their cells, one task a model adds up the tasks' sums.
    """
    width, nodes = len(codes.cuts), 1 << len(trees[0].levels)
    schema = "model int, sums binary"

    def of_cells(batches):
        held = {}
        for batch in batches:
            for r in batch.to_pylist():
                code = np.frombuffer(r["codes"], codes.kind).reshape(width, -1)
                won, lost = np.frombuffer(r["won"]), np.frombuffer(r["lost"])
                for k in (k for k, last in enumerate(upto) if r["part"] <= last):
                    behind = lambda i, b: code[i] >= codes.firsts[k][i][b + 1]  # noqa: B023, E731
                    margin = margins(done[k], r["cells"], behind)
                    # the first tree learns the label as 1 and -1, the others the negative gradient of the logistic loss
                    weight, target = won + lost, won - lost if margin is None else won * (4.0 / (1.0 + np.exp(2.0 * margin))) - lost * (4.0 / (1.0 + np.exp(-2.0 * margin)))
                    at = trees[k].leaf(r["cells"], behind).astype(np.intp)
                    sums = held.setdefault(k, [np.zeros((2, nodes * size)) for size in codes.sizes])
                    for i, size in enumerate(codes.sizes):
                        place = at * size + code[i] if nodes > 1 else code[i].astype(np.intp)
                        sums[i][0] += np.bincount(place, weight, nodes * size)
                        sums[i][1] += np.bincount(place, target, nodes * size)
        if held:
            yield from arrow_rows(schema, model=list(held), sums=[in_bins(k, sums).tobytes() for k, sums in held.items()]).to_batches()

    def in_bins(k, sums):
        out = np.zeros((nodes, width, WIDTH, 2))
        for i, (size, found) in enumerate(zip(codes.sizes, sums)):
            first = codes.firsts[k][i]
            out[:, i, : len(first)] = np.moveaxis(np.add.reduceat(found.reshape(2, nodes, size), first, axis=2), 0, -1)
        return out

    def of_tasks(table):
        return arrow_rows(schema, model=[table["model"][0].as_py()], sums=[sum(np.frombuffer(x) for x in table["sums"].to_pylist()).tobytes()])

    found = blocks.mapInArrow(of_cells, schema).groupBy("model").applyInArrow(of_tasks, schema).collect()
    return {r["model"]: np.frombuffer(r["sums"]).reshape(nodes, width, WIDTH, 2) for r in found}


def margins(trees: Sequence[Tree], n: int, to_right: Callable[[int, int], np.ndarray]) -> np.ndarray | None:
    """Half the log odds of label 1; the first tree counts whole, the others by the step."""
    out = None
    for tree in trees:
        value = tree.values[tree.leaf(n, to_right)]
        out = value if out is None else out + STEP * value
    return out


def fit_nested(df: DataFrame, features: Sequence[str], label: str, weight: str, part: str, upto: Sequence[int], max_iter: int, depth: int) -> Callable[[Column], Column]:
    """Boosted classification of nested parts; the result gives the probability of label 1 by the model of a number (none: null).

    Model k learns from all rows whose ``part`` is at most ``upto[k]``. A common factor of the weights changes no tree.
    """
    at = {x: F.when(F.col(label) == x, F.col(weight)).otherwise(0.0).cast("double") for x in (0, 1)}
    rows = df.select(F.col(part).cast("int").alias("part"), at[1].alias("won"), at[0].alias("lost"), *[value_of(f).alias(f"v{i}") for i, f in enumerate(features)])
    codes = Codes(nested_limits(rows, len(features), upto))
    blocks = cells(rows, codes)
    done: list[list[Tree]] = [[] for _ in upto]
    for _ in range(max_iter):
        trees = [Tree([], np.zeros(1)) for _ in upto]
        for _ in range(depth):
            sums = level_sums(blocks, codes, upto, done, trees)
            trees = [grown(t, sums[k]) for k, t in enumerate(trees)]
        done = [[*d, t] for d, t in zip(done, trees)]
    used = sorted({s[0] for d in done for t in d for level in t.levels for s in level if s})

    @F.arrow_udf("double")
    def score(model: pa.Array, *columns: pa.Array) -> pa.Array:
        own = model.fill_null(-1).to_numpy(zero_copy_only=False)
        out = np.full(len(own), np.nan)
        for k, trees in enumerate(done):
            rows = np.flatnonzero(own == k)
            value = {i: c.to_numpy(zero_copy_only=False)[rows] for i, c in zip(used, columns)}

            def behind(i, b, k=k, value=value):
                ends = codes.limits[k][i]
                return ~(value[i] < ends[b]) if b < len(ends) else np.isnan(value[i])

            if len(rows):
                out[rows] = 1.0 / (1.0 + np.exp(-2.0 * margins(trees, len(rows), behind)))
        return pa.array(out, mask=own < 0)

    return lambda model: score(model, *[value_of(features[i]) for i in used])
