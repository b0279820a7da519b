"""Tables replaced as a whole: each version is a folder of its own, one small pointer file makes it current.

``path/_current/N`` names the folder of version N below ``path.versions``; the highest N counts. A version is
written in full before its pointer appears in one rename, so a reader sees the old table or the new one, also while
a replacement runs and after one that failed. Two writers who start from the same version cannot both win. Reading
``path`` itself as Parquet fails instead of giving something else; use ``read_current``. Older tables
that are plain Parquet under ``path`` count as version 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

#: Versions that stay on disk: the current one and what readers may still hold.
KEEP = 2


def files(spark: SparkSession, path: str):
    """The path as Hadoop knows it and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def version_numbers(spark: SparkSession, path: str) -> list[int]:
    """All committed versions, ascending."""
    p, fs = files(spark, f"{path}/_current")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n) for n in names if n.isdigit())


def folder_of(spark: SparkSession, path: str, number: int) -> str:
    p, fs = files(spark, f"{path}/_current/{number}")
    stream = fs.open(p)
    try:
        name = bytes(b & 0xFF for b in stream.readAllBytes()).decode()
    finally:
        stream.close()
    return f"{path}.versions/{name}"


def current(spark: SparkSession, path: str) -> str | None:
    """The folder that holds the table now; None where there is none."""
    numbers = version_numbers(spark, path)
    if numbers:
        return folder_of(spark, path, numbers[-1])
    p, fs = files(spark, path)
    plain = fs.exists(p) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(p))
    return path if plain else None


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The table as it is now; the frame keeps reading this version whatever comes after."""
    folder = current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"{path} holds no table")
    return spark.read.parquet(folder)


def commit(spark: SparkSession, path: str, folder: str, after: int) -> None:
    """Make ``folder`` the version behind ``after``; refused where another writer was first."""
    jvm = spark.sparkContext._jvm
    target, fs = files(spark, f"{path}/_current/{after + 1}")
    fs.mkdirs(target.getParent())
    staged = jvm.org.apache.hadoop.fs.Path(f"{path}/_current/.{uuid.uuid4().hex}")
    out = fs.create(staged)
    out.write(bytearray(folder.rsplit("/", 1)[1].encode()))
    out.close()
    if fs.exists(target) or not fs.rename(staged, target):
        fs.delete(staged, False)
        raise ValueError(f"{path}: version {after + 1} was written by another job")


def replace_version(df: DataFrame, path: str, partition_by: Sequence[str] = (), allowed: Callable[[str | None, str], None] | None = None) -> str:
    """Write ``df`` as the next version and return its folder.

    ``allowed(current folder, new folder)`` may refuse the new version by an exception; it is then removed. Versions
    older than the last two go.
    """
    spark = df.sparkSession
    numbers = version_numbers(spark, path)
    folder = f"{path}.versions/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    try:
        writer.parquet(folder)
        if allowed:
            allowed(current(spark, path), folder)
        commit(spark, path, folder, numbers[-1] if numbers else 0)
    except Exception:
        p, fs = files(spark, folder)
        fs.delete(p, True)
        raise
    for n in numbers[: 1 - KEEP] if KEEP > 1 else numbers:
        p, fs = files(spark, folder_of(spark, path, n))
        fs.delete(p, True)
        p, fs = files(spark, f"{path}/_current/{n}")
        fs.delete(p, False)
    return folder
