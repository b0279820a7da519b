"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups of equal texts are hashed into a fixed number of cells, so what the driver places has a size
that does not grow with the corpus. A heavy group is an item of its own; only one larger than a shard's
fair share, which no shard can hold, is split by document. The placement goes from the heaviest item to the
lightest; each goes where the dot product of its vector with the shard's residual capacity is highest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.base import query, stored, table

CELLS = 1 << 16
#: A group beyond this share of all bytes, tokens or rows is placed apart from the cells; at most 3 / HEAVY_SHARE groups can be.
HEAVY_SHARE = 1 / 512
#: Parts of a group that is larger than a shard.
PARTS = 256


#: Importance of bytes, tokens and rows in the dot product; the law asks for bytes first.
IMPORTANCE = np.array([1.0, 0.5, 0.5])


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of ``vectors``), heaviest first, by dot product with residual capacity.

    Vectors are scaled so that a shard's fair share is 1 in each dimension, then weighed. Residuals may
    fall below 0 at the end, where the least overfull shard wins by the same product.
    """
    scaled = vectors / np.maximum(vectors.sum(axis=0) / shards, 1e-12) * np.sqrt(IMPORTANCE)
    residual = np.ones((shards, 1)) * np.sqrt(IMPORTANCE)
    out = np.zeros(len(vectors), dtype=np.int64)
    for i in np.argsort(-scaled.max(axis=1), kind="stable"):
        best = int(np.argmax(residual @ scaled[i]))
        out[i] = best
        residual[best] -= scaled[i]
    return out


def measured(docs: DataFrame) -> DataFrame:
    """One slim row per document: id, bytes plus one, words, checksum and the hash of its text."""
    text = F.coalesce("text", F.lit(""))
    plain = F.regexp_replace(text, r"[\x09-\x0D]", " ")
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.size(F.array_remove(F.split(plain, " "), "")).cast("long").alias("n_tokens"),
        # two independent 64-bit hashes: equal texts only share a group
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), text).alias("h2"),
    )


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document with ``shard`` and ``slot``, under the law ``bytes`` (sizes near equal).

    Null texts count one byte and are a group like any other text. Repeated rows are equal texts and
    stay together unless their group is larger than a shard's share of bytes, tokens or rows. An empty table gives an empty one. Other columns of
    ``docs`` are left behind.
    """
    rows = stored(measured(docs.select("doc_id", "text")), "shard-rows")
    total = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("size", "n_tokens")], F.count("*").alias("rows")).first()
    groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("size"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("rows"))
    beyond = lambda share: F.greatest(*[F.col(c) - F.lit(total[c] * share) for c in ("size", "n_tokens", "rows")]) > 0
    # at most 3 / HEAVY_SHARE rows
    heavy = groups.where(beyond(HEAVY_SHARE)).select("h1", "h2", F.row_number().over(Window.orderBy("h1", "h2")).alias("own"), beyond(1 / shards).alias("split"))
    part = F.when(F.col("split"), F.pmod(F.xxhash64("doc_id", "h1"), F.lit(PARTS))).otherwise(0)
    cell = F.when(F.col("own").isNull(), F.pmod(F.xxhash64("h1", "h2"), F.lit(CELLS))).otherwise(CELLS + F.col("own").cast("long") * PARTS + part)
    placed = rows.join(F.broadcast(heavy), ["h1", "h2"], "left").withColumn("cell", cell)
    sums = placed.groupBy("cell").agg(F.sum("size").alias("size"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("rows"))
    # at most CELLS + 3 / HEAVY_SHARE + 3 * shards * PARTS rows of four numbers, whatever the corpus
    items = sums.orderBy("cell").toPandas()
    chosen = place(items[["size", "n_tokens", "rows"]].to_numpy(dtype=float), shards)
    spark = docs.sparkSession
    import pandas as pd

    schema = "cell long, shard int"
    cells = spark.createDataFrame(pd.DataFrame({"cell": items["cell"].astype("int64"), "shard": chosen.astype("int32")}), schema)
    return numbered(placed.join(F.broadcast(cells), "cell"), total["rows"])


def numbered(placed: DataFrame, n_rows: int, block_rows: int = 1 << 18) -> DataFrame:
    """Gapless slots per shard: ordinals inside (shard, block) plus the counts of the blocks before."""
    blocks = max(16, -(-n_rows // block_rows))
    slim = placed.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)))
    slim = stored(slim.select("doc_id", "size", "text_crc32", "shard", "block", F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32")).alias("nth")), "shard-slots")
    counts = slim.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return slim.join(offsets, ["shard", "block"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op7_vector_sharding")
def op7(spark, sf_dir):
    """All documents into 16 shards of near equal bytes."""
    return shard(table(spark, sf_dir, "documents"))
