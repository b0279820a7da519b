"""Line, JSON, CSV and raw-file sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, schema: str, drop_malformed: bool = True) -> DataFrame:
    """Append-only JSON lines with a fixed schema; blank lines are skipped."""
    mode = "DROPMALFORMED" if drop_malformed else "FAILFAST"
    return spark.read.schema(schema).option("mode", mode).json(path)


def append_log(df: DataFrame, path: str, time: str) -> None:
    """Append records to a JSON-lines log with one folder per day."""
    df.withColumn("dt", F.date_format(time, "yyyy-MM-dd")).write.mode("append").partitionBy("dt").json(path)


def report_rows(text: Column, row_schema: str) -> Column:
    """Rows of a report text: a list, an object with ``rows``, or one object."""
    listed = F.from_json(text, f"array<{row_schema}>")
    nested = F.from_json(text, f"struct<rows:array<{row_schema}>>")["rows"]
    single = F.from_json(text, row_schema)
    return (
        F.when(text.rlike(r"^\s*\["), listed)
        .when(nested.isNotNull(), nested)
        .otherwise(F.filter(F.array(single), lambda r: r.isNotNull()))
    )


def write_shards(df: DataFrame, path: str, shards: int, key: str) -> str:
    """Write a table as JSON shards with a manifest of row counts per shard."""
    placed = df.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)))
    placed.write.mode("overwrite").partitionBy("shard").json(f"{path}/data")
    written = df.sparkSession.read.json(f"{path}/data")
    counts = written.groupBy("shard").agg(F.count("*").alias("rows"))
    counts.select(F.concat(F.lit("shard="), F.col("shard").cast("string")).alias("file"), "rows").coalesce(1).write.mode(
        "overwrite"
    ).json(f"{path}/manifest")
    return path


def read_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read the shards a manifest lists; a row count off the manifest is an error."""
    listed = spark.read.schema("file string, rows long").json(f"{path}/manifest").collect()
    files = [f"{path}/data/{r['file']}" for r in listed]
    df = spark.read.schema(schema).option("basePath", f"{path}/data").json(files)
    found, expected = df.count(), sum(r["rows"] for r in listed)
    if found != expected:
        raise ValueError(f"{path}: manifest says {expected} rows, shards hold {found}")
    return df


def raw_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog of a folder of raw payload files: path, size, SHA-256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def archive_payloads(df: DataFrame, payload: str, path: str, keys: Sequence[str]) -> None:
    """Archive payload texts with their content hash, by which copies can be found."""
    content = F.encode(payload, "utf-8")
    df.select(*keys, payload, F.sha2(content, 256).alias("sha256"), F.octet_length(payload).alias("size")).write.mode(
        "append"
    ).parquet(path)


def write_leaderboard(df: DataFrame, path: str) -> None:
    """CSV with a header and columns in name order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("header", True).csv(path)

