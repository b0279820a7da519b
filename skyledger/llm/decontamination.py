"""Benchmark decontamination: size-partitioned MinHash containment search.

The test items are cut into partitions by size (powers of two of their shingle count). An item's
signature is its bottom-k MinHash sketch: the k shingles of smallest hash, where k is set by the
partition's largest size so that a document that holds the wanted share of the item must hold one of
them: of n shingles at most n - ceil(t n) may be missing, so of any n - ceil(t n) + 1 one is present.
The search therefore loses nothing at any document length. A document's shingles pass a bit filter of
the signatures, what passes meets the signatures in a join, and candidate pairs are verified by exact
shingle containment.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.base import map_batches, query, stored, table, texts
from skyledger.llm.shingles import WordHashes, shingles, windows

SIZE, PERCENT = 5, 80
#: Bits of a filter: a fixed size, whatever the number of items.
FILTER_BITS = 1 << 23


def item_shingles(items: DataFrame, size: int) -> DataFrame:
    """``item_id``, ``words`` (length of the runs that are compared) and ``shingle`` of each item.

    An item of fewer words than ``size`` is one run of all its words; one without words has none.
    """

    def run(batches):
        words = WordHashes()
        for batch in batches:
            out: dict = {"item_id": [], "words": [], "shingle": []}
            for item_id, text in zip(batch["item_id"], batch["text"], strict=True):
                hashes = words.of(text)
                own = shingles(hashes, size)
                out["item_id"] += [item_id] * len(own)
                out["words"] += [min(size, len(hashes))] * len(own)
                out["shingle"] += own.view(np.int64).tolist()
            yield out

    own = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    return map_batches(own, run, "item_id long, words int, shingle long").distinct()


def signatures(own: DataFrame, percent: int) -> DataFrame:
    """The item shingles with ``n`` (shingles of the item), ``part`` (size partition) and ``signed``.

    ``signed`` marks the bottom-k sketch. k follows from the upper size of the partition, so all items
    of a partition have sketches of one length (shorter items: all of their shingles at most).
    """
    sizes = own.groupBy("item_id").agg(F.count("*").alias("n"))
    sized = own.join(sizes, "item_id").withColumn("part", F.ceil(F.log2("n")).cast("int"))
    upper = F.pow(F.lit(2.0), F.col("part"))
    k = F.floor(upper * (100 - percent) / 100) + 1
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy(F.xxhash64("shingle"), "shingle"))
    return sized.withColumn("signed", nth <= k)


def bit_filter(values: DataFrame, bits: int = FILTER_BITS) -> bytes:
    """One bit for each value's hash, joined by bitwise or."""
    slots = values.select(F.pmod("shingle", F.lit(bits)).alias("slot")).selectExpr("cast(slot div 8 AS int) AS byte", "shiftleft(1, cast(slot % 8 AS int)) AS bit")
    rows = slots.groupBy("byte").agg(F.bit_or("bit").alias("mask")).toPandas()  # at most bits / 8 rows
    out = np.zeros(bits // 8, dtype=np.uint8)
    out[rows["byte"].to_numpy(dtype=int)] = rows["mask"].to_numpy(dtype=int)
    return out.tobytes()


def in_filter(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes.view(np.int64) % (len(filter_) * 8)
    return (filter_[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def hits(docs: DataFrame, signed: bytes, every: bytes, lengths: list[int]) -> DataFrame:
    """Distinct shingles of each document that may be an item's, for documents with one that may be signed.

    ``row`` is an id of the row (repeated ids have rows of their own).
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((signed, every))

    def run(batches):
        words = WordHashes()
        signed_, every_ = (np.frombuffer(b, dtype=np.uint8) for b in sent.value)
        for batch in batches:
            out: dict = {"row": [], "shingle": []}
            for row, text in zip(batch["row"], batch["text"], strict=True):
                hashes = words.of(text)
                found = [windows(hashes, n) for n in lengths]
                if any(in_filter(signed_, f).any() for f in found):
                    own = np.unique(np.concatenate([f[in_filter(every_, f)] for f in found])).view(np.int64).tolist()
                    out["row"] += [row] * len(own)
                    out["shingle"] += own
            if out["row"]:
                yield out

    return map_batches(docs, run, "row string, shingle long")


def contained(docs: DataFrame, items: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row per document and item of which it holds at least ``percent`` / 100 of the shingles.

    ``doc_id``, ``item_id``, ``n_item`` (shingles of the item), ``n_shared``. Null, empty and wordless
    texts on either side match nothing. Repeated rows match alike, each with a row of its own; repeated
    item ids are one item with the shingles of all its rows. Other columns are left behind.
    """
    own = stored(signatures(item_shingles(items, size), percent), "items")
    lengths = sorted(r["words"] for r in own.select("words").distinct().collect())  # at most ``size``
    rows = texts(docs).withColumn("row", F.concat_ws(":", F.col("doc_id").cast("string"), F.monotonically_increasing_id().cast("string")))
    if not lengths:
        return rows.limit(0).selectExpr("doc_id", "cast(0 as bigint) AS item_id", "cast(0 as bigint) AS n_item", "cast(0 as bigint) AS n_shared")
    found = stored(hits(rows.select("row", "text"), bit_filter(own.where("signed")), bit_filter(own), lengths), "hits")
    candidates = found.join(own.where("signed").select("shingle", "item_id"), "shingle").select("row", "item_id").distinct()
    # a candidate's item first: by shingle alone, a phrase of many items and documents would meet in all pairs
    shared = candidates.join(own.select("shingle", "item_id", "n"), "item_id").join(found, ["row", "shingle"])
    counted = shared.groupBy("row", "item_id").agg(F.max("n").alias("n_item"), F.count("*").alias("n_shared")).where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    first = F.substring_index("row", ":", 1)
    return counted.select(F.when(F.instr("row", ":") > 0, first).cast("long").alias("doc_id"), "item_id", "n_item", "n_shared")


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go, all others stay as they are.

    Rows of a null id are judged with all other rows of a null id.
    """
    found = contained(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return own.join(found.withColumnRenamed("doc_id", "bad"), own["doc_id"].eqNullSafe(F.col("bad")), "left_anti")


def reference_sql(size: int = SIZE, percent: int = PERCENT) -> str:
    """The same table in DuckDB SQL, by exact shingles alone."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
    return f"""
    WITH i AS (SELECT item_id, {words} AS w FROM benchmark),
    ig AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT item_id, w, least({size}, len(w)) AS k, unnest(range(1, len(w) - least({size}, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
    n AS (SELECT item_id, count(*) AS n FROM ig GROUP BY item_id),
    d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
    dk AS (SELECT rid, doc_id, w, k FROM d, (SELECT DISTINCT k FROM ig) WHERE len(w) >= k),
    dg AS (SELECT DISTINCT rid, doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT rid, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dk))
    SELECT doc_id, item_id, max(n) AS n_item, count(*) AS n_shared FROM dg JOIN ig USING (k, s) JOIN n USING (item_id) GROUP BY rid, doc_id, item_id HAVING count(*) * 100 >= max(n) * {percent}"""


@query("op9_benchmark_decontamination", reference_sql())
def op9(spark, sf_dir):
    """Documents that hold a benchmark item."""
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
