"""Best-fit packing by a configuration linear program over the length histogram.

Texts become token pieces of at most ``capacity``; only the histogram of piece lengths (at most
``capacity`` numbers) reaches the driver. There the fractional covering program over configurations
(multisets of lengths that fit one sequence) is solved by multiplicative weights: lengths that are
short of copies gain weight, and a knapsack dynamic program prices the best configuration under the
weights. Whole copies of the solution are kept, the rest is packed best fit on the histogram. The plan
is a short table of runs; pieces find their place by their rank among pieces of the same length.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.base import map_batches, query, stored, table, texts

CAPACITY = 1024
END_ID = 2
#: Remembered pieces of a task; the memory is emptied when it is full.
REMEMBERED = 300_000
#: A space next to white space: the text can't be cut at single spaces there.
ODD_SPACE = re.compile(r"\s\s* | \s")


class PieceIds(dict):
    """Token ids of a text piece as little-endian unsigned 32-bit numbers, remembered by piece."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.added = added_tokens(path)
        # the longest of those that begin at a place; with the tokens themselves kept by the split
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.encoding = tiktoken.Encoding("piece", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = np.array(self.encoding.encode_ordinary(piece), dtype="<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def of(self, text: str) -> bytes:
        """Ids of a whole text. The vocabulary never joins across a single space that stands between
        two other characters, so such texts are cut there; other texts are encoded whole."""
        if ODD_SPACE.search(text):
            return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        return self[first] + b"".join([self[" " + word] for word in rest])


    def with_added(self, text: str) -> bytes:
        """Ids of a whole text as the tokenizer gives them as it is loaded: added tokens in it are one id each."""
        if self.marks is None or not self.marks.search(text):
            return self.of(text)
        parts = self.marks.split(text)  # texts and added tokens by turns
        return b"".join(np.array([self.added[part]], dtype="<u4").tobytes() if i % 2 else self.of(part) if part else b"" for i, part in enumerate(parts))


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the added tokens of the vocabulary at ``path``, from the tokenizer's JSON beside it."""
    beside = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceIds:
    return PieceIds(path)


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Piece lengths of ``n`` tokens: full ones behind a first that takes the rest."""
    full, rest = divmod(n, capacity)
    return ([rest] if rest else []) + [capacity] * full


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Token pieces of every document, each with its rank among the same lengths of its task.

    The ranks are part of the written rows, so a task that is run again cannot shift them.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        ids_of, seen = encoder(path).with_added, Counter()
        part = TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids, start = ids_of(text) + end, 0
                for piece, length in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, piece, start, length, zlib.crc32(own), part, seen[length], own))
                    seen[length] += 1
                    start += length
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids")
            yield dict(zip(names[: 7 + with_ids], zip(*rows, strict=True), strict=False))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * with_ids
    return map_batches(texts(docs), run, schema)


def best_configuration(weights: np.ndarray, capacity: int) -> tuple[dict[int, int], float]:
    """The multiset of lengths of at most ``capacity`` with the largest weight: unbounded knapsack.

    ``weights[s]`` is the weight of length s (0 where there is none).
    """
    lengths = np.nonzero(weights)[0]
    best = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, dtype=np.int64)
    values = weights[lengths]
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room], choice[room] = best[room - 1], 0
        if n := upto[room]:
            gain = best[room - lengths[:n]] + values[:n]
            top = int(np.argmax(gain))
            if gain[top] > best[room]:
                best[room], choice[room] = gain[top], lengths[top]
    out: Counter = Counter()
    room = capacity
    while room > 0:
        if choice[room]:
            out[int(choice[room])] += 1
            room -= int(choice[room])
        else:
            room -= 1
    return dict(out), float(best[capacity])


def solve(counts: np.ndarray, capacity: int, rounds: int = 600, step: float = 0.5, rate: float = 0.5) -> list[tuple[dict[int, int], float]]:
    """Fractional cover of ``counts`` (pieces by length) by configurations, near the least number.

    Multiplicative weights over the lengths: they start at the share of a sequence that the length
    takes, which is what the dual program pays where sequences can be filled. Each round the knapsack
    prices the configuration of most weight; it is taken for a ``step`` of what its scarcest length
    still needs, and the weights of its lengths shrink in proportion to what of their need was met.
    A length that is met weighs nothing. ``rounds`` bounds the work, so some lengths may stay short.
    """
    need = counts.astype(float)
    weights = np.where(need > 0, np.arange(len(need)) / capacity, 0.0)
    met = np.zeros(len(need))
    used: Counter = Counter()
    for _ in range(rounds):
        config, _ = best_configuration(weights, capacity)
        if not config:
            break
        sizes, times = np.array(list(config)), np.array(list(config.values()))
        room = float(np.min((need[sizes] - met[sizes]) / times))
        copies = room if room <= 1 else max(1.0, room * step)
        used[tuple(sorted(config.items()))] += copies
        met[sizes] += copies * times
        weights[sizes] *= np.exp(-rate * copies * times / need[sizes])
        weights[met >= need - 1e-9] = 0.0
    return [(dict(config), copies) for config, copies in used.items()]


def rounded(counts: np.ndarray, capacity: int, solution: list[tuple[dict[int, int], float]]) -> list[tuple[dict[int, int], int]]:
    """Whole copies of the solution, then best fit decreasing for what rounding leaves.

    A configuration counts as whole from ``least`` copies on; of a few such levels the one that ends
    with the fewest sequences is kept, since rare lengths pack better together than rounded one by one.
    """
    solution = sorted(solution, key=lambda x: -sum(s * k for s, k in x[0].items()))
    best: list[tuple[dict[int, int], int]] | None = None
    for least in (1, 2, 4, 16, 64):
        left = counts.astype(np.int64).copy()
        plan: list[tuple[dict[int, int], int]] = []
        for config, copies in solution:
            n = min(int(copies + 1e-9), *(int(left[s] // k) for s, k in config.items()))
            if n >= least:
                plan.append((config, n))
                for s, k in config.items():
                    left[s] -= n * k
        plan += best_fit(left, capacity)
        if best is None or sum(n for _, n in plan) < sum(n for _, n in best):
            best = plan
    return best or []


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing on a histogram, equal bins at a time.

    Each step opens the bins of the longest length left and fills their room with the fullest subset
    of the other lengths (the same knapsack, weighted by length), as often as the histogram allows.
    """
    left = left.copy()
    plan = []
    while (present := np.nonzero(left)[0]).size:
        first = int(present[-1])
        config = Counter({first: 1})
        room = capacity - first
        while room > 0:
            usable = present[present <= room]
            usable = [int(s) for s in usable[::-1] if left[s] > config[int(s)]]
            if not usable:
                break
            config[fullest(left, config, usable, room)] += 1
            room = capacity - sum(s * k for s, k in config.items())
        n = min(int(left[s] // k) for s, k in config.items())
        plan.append((dict(config), n))
        for s, k in config.items():
            left[s] -= n * k
    return plan


def fullest(left: np.ndarray, config: Counter, usable: list[int], room: int) -> int:
    """The longest length whose rest can be filled by one more length, else the longest that fits."""
    free = {s for s in usable}
    for s in usable:
        rest = room - s
        if rest == 0 or (rest in free and (rest != s or left[s] > config[s] + 1)):
            return s
    return usable[0]


def plan_runs(plan: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """Runs of ranks: pieces ``first <= rank < last`` of a length fill ``times`` places of each of the
    bins from ``bin`` on, the first place at ``offset``."""
    taken: Counter = Counter()
    rows, opened = [], 0
    for config, n in plan:
        offset = 0
        for length, times in sorted(config.items(), reverse=True):
            rows.append((length, taken[length], taken[length] + n * times, times, opened, offset))
            taken[length] += n * times
            offset += length * times
        opened += n
    frame = pd.DataFrame(rows, columns=["length", "first", "last", "times", "bin", "offset"])
    return frame.astype("int64")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence and its offset there.

    Null texts are empty: one piece of the end token. Repeated rows are packed like any others; an
    empty table gives an empty one. Other columns of ``docs`` are left behind. ``path`` names the
    vocabulary file of ranks; ``with_ids`` adds the token ids themselves.
    """
    spark = docs.sparkSession
    found = stored(pieces(docs, path or public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity, end_id, with_ids), "pack-pieces")
    by_part = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = by_part.groupBy("length").agg(F.sum("n").alias("n")).toPandas()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    counts[histogram["length"].to_numpy(dtype=int)] = histogram["n"].to_numpy(dtype=int)
    plan = rounded(counts, capacity, solve(counts, capacity))
    runs = plan_runs(plan)
    runs_of = {int(length): part.sort_values("first").reset_index(drop=True) for length, part in runs.groupby("length")}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = found.join(offsets, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    more = ["ids"] if with_ids else []
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", *more)

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            length = batch.column("length").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for size in np.unique(length):
                at = np.nonzero(length == size)[0]
                own = runs_of[int(size)]
                run = np.searchsorted(own["first"].to_numpy(), rank[at], side="right") - 1
                row = {name: own[name].to_numpy()[run] for name in ("first", "times", "bin", "offset")}
                nth = rank[at] - row["first"]
                sequence[at] = row["bin"] + nth // row["times"]
                offset[at] = row["offset"] + nth % row["times"] * size
            kept = batch.drop_columns(["rank"])
            yield kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    return ranked.mapInArrow(place, schema)


@query("op3_best_fit_packing")
def op3(spark, sf_dir):
    """All documents into sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
