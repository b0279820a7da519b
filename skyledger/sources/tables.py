"""Columnar table scans and writes, and the market-product views over the given tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.sources.versions import replace_version


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan; zone-less timestamps are read as UTC instants."""
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    return utc_timestamps(df)


def utc_timestamps(df: DataFrame) -> DataFrame:
    zoneless = {f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
    if not zoneless:
        return df
    return df.select(*[F.col(c).cast("timestamp").alias(c) if c in zoneless else F.col(c) for c in df.columns])


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One of the given tables by name."""
    return read_table(spark, f"{sf_dir}/{name}.parquet", columns)


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Write a table as a whole and return the folder that holds it; readers use ``read_current``.

    A reader during the swap, or after a failed one, sees the whole old table.
    """
    return replace_version(df, path, partition_by)


def export_query(spark: SparkSession, sql: str, path: str) -> DataFrame:
    """Write the result of a SQL query and return the written table."""
    return spark.read.parquet(replace_table(spark.sql(sql), path))
