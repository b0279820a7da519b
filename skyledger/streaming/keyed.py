"""Keyed results of streams that a batch changes only where it has rows.

Every epoch writes what it adds or changes in a folder of its own; now and then the folders are folded into one.
A reader merges the newest fold with the epochs behind it, by aggregates that give the same in any
grouping. A replayed epoch overwrites its own folder and reads only what came before it, so it does
no harm; an epoch whose predecessors are not all there is refused rather than started anew.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from skyledger.operators.merge import path_exists


def numbered(spark: SparkSession, folder: str, name: str) -> set[int]:
    """The numbers N of the finished tables ``folder/name=N``."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return set()
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    found = {int(n.split("=")[1]) for n in names if n.startswith(f"{name}=")}
    return {n for n in found if path_exists(spark, f"{folder}/{name}={n}/_SUCCESS")}


def removed(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@dataclass
class KeyedTable:
    """A table by key, kept as epochs and folds under ``path``.

    ``merged`` are aggregates over the stored columns that keep their names; they must be such that merging in
    parts and at once is the same.
    """

    spark: SparkSession
    path: str
    keys: Sequence[str]
    merged: Sequence[Column]
    fold_every: int = 16

    @property
    def checkpoint(self) -> str:
        return f"{self.path}/checkpoint"

    def parts(self, before: int | None = None) -> list[str]:
        """The folders that together hold all epochs below ``before`` (none: all there are)."""
        epochs = numbered(self.spark, f"{self.path}/epochs", "epoch")
        folds = {n for n in numbered(self.spark, f"{self.path}/folds", "upto") if before is None or n < before}
        start = max(folds, default=-1)
        end = max(epochs, default=start) + 1 if before is None else before
        missing = sorted(set(range(start + 1, end)) - epochs)
        if missing:
            raise ValueError(f"{self.path}: epoch {missing[0]} is missing, so what came before epoch {end} is not known")
        head = [f"{self.path}/folds/upto={start}"] if start >= 0 else []
        return head + [f"{self.path}/epochs/epoch={n}" for n in range(start + 1, end)]

    def read(self, before: int | None = None) -> DataFrame | None:
        """One row per key, merged; None where nothing has been written."""
        paths = self.parts(before)
        if not paths:
            return None
        rows = self.spark.read.schema(self.spark.read.parquet(paths[-1]).schema).parquet(*paths)
        return rows.groupBy(*self.keys).agg(*self.merged)

    def write(self, rows: DataFrame, epoch: int) -> None:
        """What ``epoch`` adds; each ``fold_every`` epochs all are folded."""
        later = {n for n in numbered(self.spark, f"{self.path}/epochs", "epoch") if n > epoch}
        if later:
            raise ValueError(f"{self.path}: epoch {max(later)} is there already; these are not the results of this checkpoint")
        self.parts(epoch)
        rows.write.mode("overwrite").parquet(f"{self.path}/epochs/epoch={epoch}")
        if (epoch + 1) % self.fold_every == 0:
            self.fold(epoch)

    def fold(self, epoch: int) -> None:
        """Merge all epochs up to this one; what the fold before it holds is removed, as no replay goes back so far."""
        older = sorted(n for n in numbered(self.spark, f"{self.path}/folds", "upto") if n < epoch)
        self.read(epoch + 1).write.mode("overwrite").parquet(f"{self.path}/folds/upto={epoch}")
        if older:
            for n in numbered(self.spark, f"{self.path}/epochs", "epoch"):
                if n <= older[-1]:
                    removed(self.spark, f"{self.path}/epochs/epoch={n}")
            for n in older[:-1]:
                removed(self.spark, f"{self.path}/folds/upto={n}")


def run_keyed(stream: DataFrame, table: KeyedTable, step: Callable[[DataFrame, int], DataFrame]):
    """Run ``step`` on every micro-batch and keep its rows; a later run goes on behind the last epoch."""
    from skyledger.streaming.jobs import run_available

    return run_available(stream.writeStream.foreachBatch(lambda batch, epoch: table.write(step(batch, epoch), epoch)), table.checkpoint)
