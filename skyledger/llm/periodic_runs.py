"""Periodic runs of words, found with a dictionary of basic factors.

A basic factor is a stretch of 2^k words; equal factors share a name, and the names of one level are pairs of
names of the level below. For each level the next occurrence of every factor within twice its length is
looked up. Where it comes again after the same distance, the three occurrences are an arithmetic progression
and the distance is a proposed period. Proposals at neighbouring positions are one, which is extended word by
word to both sides; what several levels find is kept once.

A run has at least four periods. At the level where 2^(k-1) < period <= 2^k a factor inside it is at least a
period long, so its next occurrence is exactly one smallest period away (a primitive word does not occur
inside its own square elsewhere) and there are three in a row: no run is missed and none gets a multiple of its
period. Only factors that occur twice are carried to the next level, so plain prose ends after a few.

A document is one row, so it is in one task by nature; Spark deals the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.base import SPACE, map_batches, query, table

#: Least words and least periods of a run.
LEAST_WORDS = 6
LEAST_PERIODS = 4
RUNS = "array<struct<start:long,length:long,period:long>>"


def successors(names: np.ndarray, at: np.ndarray, within: int, n: int) -> np.ndarray:
    """Distance from each position to the next one of the same name, 0 where there is none within reach.

    ``names`` are those of the positions ``at`` (ascending); all other positions have no equal.
    """
    order = np.argsort(names, kind="stable")
    sorted_at, sorted_names = at[order], names[order]
    gap = np.diff(sorted_at)
    gap[(np.diff(sorted_names) != 0) | (gap > within)] = 0
    out = np.zeros(n, dtype=np.int64)
    out[sorted_at[:-1]] = gap
    return out


def repeated(names: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions whose name occurs twice and more, with names counted from 0."""
    _, inverse, counts = np.unique(names, return_inverse=True, return_counts=True)
    keep = counts[inverse] > 1
    return inverse[keep].astype(np.int64), at[keep]


def extended(words: np.ndarray, start: int, end: int, period: int) -> tuple[int, int]:
    """The longest stretch around ``[start, end)`` in which words ``period`` apart are equal."""
    step = 16
    while start > 0:
        low = max(0, start - step)
        odd = np.flatnonzero(words[low:start] != words[low + period : start + period])
        if odd.size:
            start = low + int(odd[-1]) + 1
            break
        start, step = low, step * 2
    step = 16
    while end < len(words):
        high = min(len(words), end + step)
        odd = np.flatnonzero(words[end:high] != words[end - period : high - period])
        if odd.size:
            end += int(odd[0])
            break
        end, step = high, step * 2
    return start, end


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of a sequence of word numbers, by start, then period."""
    n = len(words)
    found = set()
    names, at = repeated(words, np.arange(n))
    size = 1
    while at.size:
        gap = successors(names, at, 2 * size, n)
        after = np.minimum(np.arange(n) + gap, n - 1)
        # three in arithmetic progression, the period at home on this level
        proposed = np.flatnonzero((2 * gap > size) & (gap <= size) & (gap[after] == gap))
        if proposed.size:
            new = np.ones(proposed.size, dtype=bool)
            new[1:] = (np.diff(proposed) != 1) | (np.diff(gap[proposed]) != 0)
            heads = np.flatnonzero(new)
            for head, last in zip(proposed[heads], proposed[np.append(heads[1:], proposed.size) - 1]):
                period = int(gap[head])
                start, end = extended(words, int(head), int(last) + 2 * period + size, period)
                if end - start >= max(LEAST_WORDS, LEAST_PERIODS * period):
                    found.add((start, end - start, period))
        if 2 * size * LEAST_PERIODS > 2 * n:  # no run has so long a period
            break
        name_of = np.full(n + size, -1, dtype=np.int64)
        name_of[at] = names
        right = name_of[at + size]
        both = right >= 0
        names, at = repeated(names[both] * (n + 1) + right[both], at[both])
        size *= 2
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words without those of any run behind its first period, joined by one space."""
    if not runs:
        return b" ".join(words).decode()
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join(compress(words, (np.cumsum(change)[:-1] == 0).tolist())).decode()


def run_rows(batches: Iterator[dict]) -> Iterator[dict]:
    for columns in batches:
        lengths, runs, collapsed = [], [], []
        for text in columns["text"]:
            words = text.encode().split()  # bytes split at ASCII white space only
            numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
            found = find_runs(np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)))
            lengths.append(len(words))
            runs.append([{"start": s, "length": m, "period": p} for s, m, p in found])
            collapsed.append(collapse(words, found))
        yield {"doc_id": columns["doc_id"], "n_words": lengths, "runs": runs, "collapsed": collapsed}


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` per row: all runs by start and period, and the text without their repeats.

    Null, empty and wordless texts have no run and collapse to the empty text. Repeated rows each give a row,
    a null ``doc_id`` stays null, an empty table gives an empty one. Other columns are left behind.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return map_batches(rows, run_rows, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where each tenth document by ``h = crc32(doc_id)`` ends in a repeated stretch.

    With n words and ``g = h div 10``, the words from ``a = g % n`` on repeat ``p = 1 + (n - a) div (3 + g % 8)``
    words. Other texts stay as they are, and so do rows with a null id or without words.
    """
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    words = F.array_remove(F.split(F.col("text"), f"{SPACE}+"), "")
    chosen = docs.select("doc_id", "text", F.when(F.pmod(h, F.lit(10)) == 0, words).alias("_words"), F.floor(h / 10).alias("_g"))
    n = F.size("_words")
    planted = F.col("_words").isNotNull() & (n > 0)
    a = F.when(planted, F.pmod("_g", n)).cast("int")
    placed = chosen.withColumn("_a", a).withColumn("_p", (F.floor((n - F.col("_a")) / (3 + F.pmod("_g", F.lit(8)))) + 1).cast("int"))

    def word(w: Column, i: Column) -> Column:
        return F.when(i >= F.col("_a"), F.get(F.col("_words"), F.col("_a") + F.pmod(i - F.col("_a"), F.col("_p")))).otherwise(w)

    text = F.when(planted, F.concat_ws(" ", F.transform("_words", word))).otherwise(F.col("text"))
    return placed.select("doc_id", text.alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Count, longest run (ties: smallest start, then period) and digests of the result of ``periodic_runs``."""
    best = F.reduce(
        "runs",
        F.lit(None).cast("struct<start:long,length:long,period:long>"),
        lambda held, run: F.when(held.isNull() | (run["length"] > held["length"]), run).otherwise(held),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.floor(F.col("_best.length") * 1000 / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode(F.col("collapsed"), "UTF-8"), 256).alias("collapsed_sha256"),
    )


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    """All documents, a tenth of them with a planted run."""
    return run_digests(periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"))))
