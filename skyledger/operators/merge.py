"""Keyed table maintenance: keep-last, upsert with evolution, guards, set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Numeric types from narrow to wide, for columns that arrive with two types.
NUMERIC_WIDTH = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row per key; a null order value counts as latest. Null keys form a group.

    The ``row_number() = 1`` filter lets Spark keep one row per key and task
    before the shuffle, so a hot key does not travel as a whole.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_first(c) for c in order])
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def missing_only(wanted: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``wanted`` whose key is not in ``present`` (null equals null)."""
    have = present.select(*[F.col(k).alias(f"__p_{k}") for k in keys]).distinct()
    on = reduce(lambda a, b: a & b, [wanted[k].eqNullSafe(have[f"__p_{k}"]) for k in keys])
    return wanted.join(have, on, "left_anti")


def only_in(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is in ``ids``; a semi-join, so duplicates there do no harm."""
    return df.join(ids.select(*keys), list(keys), "left_semi")


def wider(left: T.DataType, right: T.DataType) -> T.DataType:
    """The type that holds values of both; text where nothing else does."""
    if left == right:
        return left
    if isinstance(left, T.NullType):
        return right
    if isinstance(right, T.NullType):
        return left
    numeric = [type(left) in NUMERIC_WIDTH, type(right) in NUMERIC_WIDTH]
    if all(numeric):
        if {type(left), type(right)} == {T.LongType, T.FloatType}:
            return T.DoubleType()
        return max((left, right), key=lambda t: NUMERIC_WIDTH.index(type(t)))
    if {type(left), type(right)} == {T.DateType, T.TimestampType}:
        return T.TimestampType()
    return T.StringType()


def union_by_name(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union that adds missing columns as null and widens differing types."""
    lt, rt = ({f.name: f.dataType for f in d.schema.fields} for d in (left, right))
    target = {n: wider(lt[n], rt[n]) if n in lt and n in rt else lt.get(n, rt.get(n)) for n in [*lt, *rt]}

    def shaped(df: DataFrame, have: Mapping[str, T.DataType]) -> DataFrame:
        return df.select(
            *[(F.col(n).cast(t) if n in have else F.lit(None).cast(t)).alias(n) for n, t in target.items()]
        )

    return shaped(left, lt).union(shaped(right, rt))


def upsert(target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Merge on keys: incoming rows replace equal keys (null-safe), columns evolve."""
    stage = keep_last(incoming, keys, order)
    return union_by_name(missing_only(target, stage, keys), stage)


def append_new(log: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Append rows with unseen keys; the first of a batch wins."""
    return union_by_name(log, missing_only(keep_first(batch, keys, order), log, keys))


def merge_by_precedence(sources: Sequence[tuple[int, DataFrame]], keys: Sequence[str], defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """Merge sources; the higher precedence wins a key, absent key columns are filled."""
    defaults = defaults or {}
    parts = []
    for precedence, df in sources:
        for k in keys:
            if k not in df.columns:
                df = df.withColumn(k, defaults.get(k, F.lit(None).cast("string")))
        parts.append(df.withColumn("source_priority", F.lit(precedence)))
    merged = reduce(union_by_name, parts)
    return keep_last(merged, keys, ["source_priority"])


def guarded_overwrite(spark: SparkSession, df: DataFrame, path: str, protected: bool = False, unlock: bool = False, min_share: float = 0.5) -> str:
    """Replace a table unless it is protected, empty or shrinks below ``min_share``.

    The new version is written beside the old one and counted there, so the input is computed once. A refused or
    failed one leaves the table as it was; the version before stays as the backup. Returns the folder of
    the new version; readers use ``read_current``.
    """
    from skyledger.sources.versions import current, replace_version

    if protected and not unlock and current(spark, path):
        raise ValueError(f"{path} is protected; pass unlock=True to replace it")

    def allowed(old: str | None, new: str) -> None:
        rows = spark.read.parquet(new).count()
        if rows == 0:
            raise ValueError(f"{path}: nothing to write")
        before = spark.read.parquet(old).count() if old else 0
        if rows < before * min_share:
            raise ValueError(f"{path}: {before} rows would shrink to {rows}")

    return replace_version(df, path, allowed=allowed)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def zero_fill(df: DataFrame) -> DataFrame:
    """Null numbers become 0, other columns stay."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return df.fillna(0, subset=numeric)


def inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of every table in one job."""
    parts = [
        df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table_name"),
            "rows",
            F.lit(",".join(df.columns)).alias("columns"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def source_inventory(sources: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """Largest row count by target table over (source, target, table) entries."""
    parts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(s).alias("source"), F.lit(t).alias("target_table"), "rows")
        for s, t, df in sources
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("target_table").agg(
        F.max("rows").alias("max_rows"), F.max_by("source", F.struct("rows", "source")).alias("largest_source")
    )


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of every key (null-safe)."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def validate_tables(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], floors: Mapping[str, int]) -> DataFrame:
    """Row floor and duplicate check per table; a table with a floor must exist."""
    parts = []
    for name in sorted({*tables, *floors}):
        if name in tables:
            per = tables[name].groupBy(*keys[name]).agg(F.count("*").alias("n"))
            row = per.agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
            )
            parts.append(row.select(F.lit(name).alias("table_name"), "rows", "duplicates", F.lit(floors.get(name, 0)).cast("bigint").alias("floor")))
    out = reduce(DataFrame.unionByName, parts)
    status = (
        F.when(F.col("rows") < F.col("floor"), "below_floor").when(F.col("duplicates") > 0, "duplicates").otherwise("ok")
    )
    return out.withColumn("status", status)


def run_id(command: Column, config_hash: Column, started_at: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a run's identity."""
    return F.substring(F.sha2(F.concat_ws("|", command, config_hash, started_at), 256), 1, 16)


def backlog_merge(backlog: DataFrame, found: DataFrame, key: str, first: str, last: str, carry: Sequence[str]) -> DataFrame:
    """Merge discoveries into a backlog: earliest first_seen, latest last_seen,
    other columns from the discovery, else from the backlog."""
    b = backlog.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__b_{c}") for c in (first, last, *carry)])
    f = found.groupBy(key).agg(
        F.min(first).alias(f"__f_{first}"),
        F.max(last).alias(f"__f_{last}"),
        *[F.max_by(c, F.struct(last, c)).alias(f"__f_{c}") for c in carry],
    )
    j = b.join(f, b["__k"] == f[key], "full_outer")
    return j.select(
        F.coalesce(key, "__k").alias(key),
        F.least(f"__b_{first}", f"__f_{first}").alias(first),
        F.greatest(f"__b_{last}", f"__f_{last}").alias(last),
        *[F.coalesce(f"__f_{c}", f"__b_{c}").alias(c) for c in carry],
    )


def carry_forward(current: DataFrame, prior: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Take ``columns`` from a prior snapshot matched by the first key, else by the next."""
    out = current
    for i, key in enumerate(by):
        side = prior.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"__k{i}")).agg(
            *[F.min(c).alias(f"__p{i}_{c}") for c in columns]
        )
        out = out.join(side, out[key] == side[f"__k{i}"], "left")
    picks = {c: F.coalesce(*[F.col(f"__p{i}_{c}") for i in range(len(by))], F.col(c)) for c in columns}
    return out.select(*[picks[c].alias(c) if c in picks else F.col(c) for c in current.columns])


def curated_sync(curated: DataFrame, candidates: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Promote curated entries: discovery time from the candidate, else the existing
    entry, else the capture; the greater attempt count."""
    c = candidates.select(F.col(key).alias("__ck"), F.col("discovered_at").alias("__cd"), F.col("attempts").alias("__ca"))
    e = existing.select(F.col(key).alias("__ek"), F.col("discovered_at").alias("__ed"), F.col("attempts").alias("__ea"))
    out = curated.join(c, curated[key] == c["__ck"], "left").join(e, curated[key] == e["__ek"], "left")
    return out.select(
        *curated.columns,
        F.coalesce("__cd", "__ed", "captured_at").alias("discovered_at"),
        F.coalesce(F.greatest("__ca", "__ea"), F.lit(0)).alias("attempts"),
    )
