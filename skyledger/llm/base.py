"""What the corpus operators share: reading, Arrow batches, written steps, block-wise ordinals."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.session import scratch_path

#: Rows of an Arrow batch: texts can be long, so batches are short.
BATCH_ROWS = 256
#: ASCII white space as a Java, Python and DuckDB character class.
SPACE = r"[\x20\x09-\x0D]"
QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its reference SQL where there is one."""

    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and the named columns; all others are left behind."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def map_batches(df: DataFrame, function: Callable[[Iterator[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """Run ``function`` over column dictionaries of short Arrow batches, one iterator per task.

    ``function`` gets dictionaries of column lists and yields dictionaries of columns. An empty
    partition yields nothing.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    arrow = pa_schema(spark, schema)

    def run(batches):
        columns = (b.to_pydict() for b in batches if b.num_rows)
        for out in function(columns):
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def pa_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back; the copy outlives lost executors."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash_sample(rows: DataFrame, key: str, share: float) -> DataFrame:
    """The rows whose key's hash falls into the given share: the same rows in every run."""
    steps = 1 << 30
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(steps)) < int(min(1.0, share) * steps))


def fold(modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")), F.lit(modulus))


def once(column: Column) -> Column:
    """The column, held apart by a test that is always true but not foldable.

    Filters on what is built from it stay above its projection. Pushed below, they would repeat the
    array expressions under it for every use, and inside lambdas for every element.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)
