"""MinHash near-dedup with SuperMinHash signatures.

1. Each document's shingle set gets a SuperMinHash signature, cut into bands; equal sets collapse to
   one node (a digest of the set) by a map-side combined aggregate.
2. Nodes that share a band are candidates. A bucket never emits its pairs: one leader of a bucket meets
   its members, verified links merge components, and only buckets that still hold more than one
   component go on, with leaders from their smaller components. A leader that has met a bucket's members
   leaves it, so the loop ends when every pair of a bucket is verified or lies in one component. A leader
   and a member meet as a row only where their sizes and parity sketches allow a link, and in their first
   common bucket only.
3. Links are confirmed on full shingle sets and merged by union-find: inside each task, then by
   large-star and small-star rounds over written tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.base import map_batches, query, stored, table, texts
from skyledger.llm.shingles import GOLDEN, WordHashes, digest, mix, shingles

#: A pair of similarity 0.8 shares fewer than 3 of 50 bands of 5 registers with a chance of about 8e-7.
BANDS, ROWS = 50, 5
#: Bands that a pair has to share; nodes that share fewer with all others leave the buckets.
SHARED = 3
#: Elements that are hashed together.
CHUNK = 1 << 16
#: Rounds in which each node meets one leader only; then a bucket has so many leaders, and so many times
#: more in each later round.
TIES, MORE_LEADERS = 2, 16
#: 64-bit words of a set's parity sketch.
SKETCH = 16
#: Up to so many bytes of leaders' sets are sent to all tasks.
SMALL_SETS = 2_000_000
#: Up to so many document ids or pairs are sent to all tasks; more are joined by a shuffle.
SMALL_IDS = 100_000
#: Up to so many edges that tasks have left are merged by one more task; more take star rounds.
SMALL_EDGES = 100_000


def superminhash(sets: list[np.ndarray], registers: int) -> np.ndarray:
    """SuperMinHash signatures, one row of ``registers`` values for each non-empty set.

    Step j of an element draws the j-th entry of its own random permutation and offers j plus a uniform
    number to that register. All elements of all sets take a step together; a set stops early once its
    largest register is below j + 1, which no later step can lower.
    """
    sizes = np.array([len(s) for s in sets])
    values = np.full(len(sets) * registers, np.inf)
    owner = np.repeat(np.arange(len(sets)), sizes)
    elements = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    order = None
    for j in range(registers):
        if not len(elements):
            break
        draw = mix(elements + np.uint64((int(GOLDEN) * (2 * j + 1)) % (1 << 64)))
        uniform = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
        swap = j + (mix(draw ^ GOLDEN) % np.uint64(registers - j)).astype(np.int64)
        if j == 0:
            register, first = swap, swap
        else:
            if order is None:  # the permutations so far: register 0 swapped with the first draw
                order = np.tile(np.arange(registers, dtype=np.uint16), (len(elements), 1))
                at = np.arange(len(elements))
                order[at, first], order[at, 0] = 0, first
            at = np.arange(len(elements))
            register = order[at, swap].astype(np.int64)
            order[at, swap] = order[at, j]
        np.minimum.at(values, owner * registers + register, uniform + j)
        open_ = values.reshape(-1, registers).max(axis=1, initial=-np.inf) >= j + 1
        going = open_[owner]
        if not going.all():
            elements, owner = elements[going], owner[going]
            first = first[going] if order is None else first
            order = order[going] if order is not None else None
    return values.reshape(-1, registers)


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number is part of it."""
    bits = values.view(np.uint64).reshape(len(values), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN, (len(values), bands))
    for i in range(rows):
        out = mix(out * GOLDEN + bits[:, :, i])
    return out.view(np.int64)


def parity_sketch(own: np.ndarray) -> np.ndarray:
    """One bit for each cell of a set's elements: whether their number is odd.

    Common elements cancel out in the difference of two sketches, so no more bits differ than elements do.
    """
    cells = (own >> np.uint64(32)) % np.uint64(64 * SKETCH)
    return np.packbits(np.bincount(cells.astype(np.int64), minlength=64 * SKETCH).astype(np.uint8) & 1).view(np.int64)


def may_link(n: str, sketch: str, other_n: str, other_sketch: str, percent: int) -> str:
    """A condition on sizes and sketches (arrays of SKETCH words) that every pair of at least ``percent`` / 100 meets.

    Such a pair differs in at most (100 - percent) / (100 + percent) of the sum of its sizes.
    """
    differ = " + ".join(f"bit_count({sketch}[{i}] ^ {other_sketch}[{i}])" for i in range(SKETCH))
    sizes = f"{n} * 100L >= {other_n} * {percent}L AND {other_n} * 100L >= {n} * {percent}L"
    return f"{sizes} AND ({differ}) * {100 + percent}L <= ({n} + {other_n}) * {100 - percent}L"


def signed(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles``, ``node`` (digest of the set; null for none) and ``bands``."""

    def run(batches):
        words = WordHashes()
        for batch in batches:
            sets = [shingles(words.of(text), size) for text in batch["text"]]
            keys: list = [None] * len(sets)
            chunk: list[int] = []
            held = 0
            for i, own in enumerate([*sets, None]):
                if chunk and (own is None or held + len(own) > CHUNK):
                    for k, row in zip(chunk, band_keys(superminhash([sets[c] for c in chunk], bands * rows), bands, rows), strict=True):
                        keys[k] = row
                    chunk, held = [], 0
                if own is not None and len(own):
                    chunk.append(i)
                    held += len(own)
            yield {"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "n_shingles": [len(s) for s in sets], "node": [digest(s) if len(s) else None for s in sets], "bands": keys}

    own = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    return map_batches(own, run, "doc_id long, text_hash long, n_shingles long, node binary, bands array<bigint>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``node``, its full ``shingles``, their number ``n``, distinct ``low`` 16 bits and ``sketch`` for the wanted (doc_id, node).

    The texts are read again.
    """
    own = texts(docs).withColumnRenamed("doc_id", "id")
    match = own["id"].eqNullSafe(wanted["doc_id"])
    if wanted.count() <= SMALL_IDS:
        wanted = F.broadcast(wanted)
    found = own.join(wanted, match).select("node", "text")

    def run(batches):
        words = WordHashes()
        for batch in batches:
            out: dict = {"node": [], "shingles": [], "n": [], "low": [], "sketch": []}
            for node, text in zip(batch["node"], batch["text"], strict=True):
                own = shingles(words.of(text), size)
                if digest(own) == node:  # a repeated id may have other texts
                    out["node"].append(node)
                    out["shingles"].append(own.view(np.int64))
                    out["n"].append(len(own))
                    out["low"].append(np.unique(own.astype(np.uint16)).view(np.int16))
                    out["sketch"].append(parity_sketch(own))
            yield out

    sets = stored(map_batches(found, run, "node binary, shingles array<bigint>, n int, low array<smallint>, sketch array<bigint>"), "sets")
    rows = sets.agg(F.count("*").alias("n"), F.count_distinct("node").alias("nodes")).first()
    # only repeated rows of an id give a set twice; otherwise no set moves here
    return sets if rows["n"] == rows["nodes"] else stored(sets.dropDuplicates(["node"]), "sets")


def star_forest(edges: DataFrame) -> DataFrame:
    """(``a``, ``b``) for every node that is not the smallest of its component: b is the smallest.

    Tasks first shrink their own edges by union-find; what is left of few edges is merged by one task the same way. More
    of them take large-star and small-star rounds, which hang neighbours on the smallest node until nothing changes.
    """

    def shrink(batches):
        parent: dict = {}

        def root(x):
            top = x
            while parent.get(top, top) != top:
                top = parent[top]
            while parent.get(x, x) != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a, b in zip(batch["a"], batch["b"], strict=True):
                ra, rb = root(a), root(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
        pairs = [(x, root(x)) for x in list(parent)]
        pairs = [p for p in pairs if p[0] != p[1]]
        if pairs:
            yield {"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}

    edges = stored(map_batches(edges.select("a", "b").where("a <> b"), shrink, "a binary, b binary"), "stars")
    if edges.count() <= SMALL_EDGES:
        return stored(map_batches(edges.repartition(1), shrink, "a binary, b binary"), "stars")
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
        if tuple(state) == seen or not state["n"]:
            return edges
        seen = tuple(state)
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = stored(small.select("e.a", "e.b").where("a <> b").distinct(), "stars")


def met_sets(pairs: DataFrame, sets: DataFrame, column: str, size: int) -> DataFrame:
    """Stored pairs with the sets of both nodes, ``sa`` and ``sb``, elements of ``size`` bytes.

    Up to SMALL_IDS pairs go to the sets, so that only sets of pairs move, once, to their leaders ``a``. Leaders are few: their
    sets go to all tasks while they are small. Beyond that, both are joined by a shuffle.
    """
    leaders = pairs.select(F.col("a").alias("node")).distinct()
    if pairs.count() <= SMALL_IDS:
        pairs, leaders = F.broadcast(pairs), F.broadcast(leaders)
    left = sets.join(leaders, "node", "left_semi").select(F.col("node").alias("a"), F.col(column).alias("sa"))
    if left.agg(F.coalesce(F.sum(F.size("sa")), F.lit(0))).first()[0] * size <= SMALL_SETS:
        left = F.broadcast(left)
    return pairs.join(sets.select(F.col("node").alias("b"), F.col(column).alias("sb")), "b").join(left, "a")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have at least ``percent`` / 100 of their union in common.

    First sizes are compared, then the shingles' low 16 bits, a quarter of the bytes: equal shingles have
    equal bits, and no more of them can be lost than the smaller loss of the two sets, so the common bits and that
    loss are a bound that rejects nothing wrongly. Full sets decide what is left.
    """
    sizes = sets.select("node", "n")
    sized = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    sized = stored(sized.where((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)), "sized")
    enough = (100 + percent) * F.col("common") >= percent * (F.col("na") + F.col("nb"))
    rough = met_sets(sized, sets, "low", 2)
    lost = F.least(F.col("na") - F.size("sa"), F.col("nb") - F.size("sb"))
    rough = rough.select("a", "b", "na", "nb", (F.size(F.array_intersect("sa", "sb")) + lost).alias("common"))
    pairs = stored(rough.where(enough).drop("common"), "pairs")
    met = met_sets(pairs, sets, "shingles", 8)
    return met.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("common")).where(enough).select("a", "b")


def still_mixed(tagged: DataFrame) -> DataFrame:
    """Rows of the buckets that hold more than one component."""
    keys = tagged.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("key")
    return tagged.join(keys, "key", "left_semi")


def still_shared(tagged: DataFrame) -> DataFrame:
    """Rows of the nodes that are in enough buckets to share ``SHARED`` of them with any other node."""
    often = tagged.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED).select("node")
    return tagged.join(often, "node", "left_semi")


def with_main(mixed: DataFrame) -> DataFrame:
    """``main``: the label that most rows of the bucket have."""
    parts = mixed.groupBy("key", "label").agg(F.count("*").alias("n"))
    return mixed.join(parts.groupBy("key").agg(F.max(F.struct("n", "label")).getField("label").alias("main")), "key")


def node_components(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(``node``, ``label``) of the nodes of ``members`` (``key``, ``node``); labels are equal in a component."""
    labels = members.select("node").distinct().withColumn("label", F.col("node"))
    tagged = members.select("key", "node", F.col("node").alias("label"))
    leaders, ties = MORE_LEADERS, TIES
    while not tagged.isEmpty():
        met = None
        if ties:  # cheap rounds: each node meets one leader, another in each round; most links merge here
            leader = F.min(F.struct(F.xxhash64("node", F.lit(ties)).alias("h"), "node", "label"))
            first = tagged.groupBy("key").agg(leader.alias("lead")).select("key", F.col("lead.node").alias("a"), F.col("lead.label").alias("la"))
            shared = tagged.join(first, "key").where("label <> la").groupBy(F.col("node").alias("b"), "a").agg(F.count("*").alias("n"))
            pairs = shared.groupBy("b").agg(F.max(F.struct("n", "a")).alias("most")).where(F.col("most.n") >= SHARED).select(F.col("most.a").alias("a"), "b")
        else:
            tagged = with_main(tagged)
            minor = tagged.where("label <> main")
            nth = F.row_number().over(Window.partitionBy("key").orderBy("node"))
            # who leads anywhere leads in all its buckets, so that a pair's first common bucket is one where they meet
            met = stored(minor.select("key", "node").withColumn("nth", nth).where(F.col("nth") <= leaders).select("node").distinct(), "picked")
            # the buckets of a node before each of its own, at most all bands
            before = F.collect_list("key").over(Window.partitionBy("node").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
            marked = tagged.withColumn("before", before).join(sets.select("node", "n", "sketch"), "node").join(met.withColumn("leads", F.lit(True)), "node", "left")
            chosen = marked.where("leads").selectExpr("key", *[f"{c} AS leader_{c}" for c in ("node", "label", "n", "sketch", "before")])
            apart = "label <> leader_label AND (leads IS NULL OR node > leader_node)"
            meets = f"{apart} AND {may_link('n', 'sketch', 'leader_n', 'leader_sketch', percent)} AND NOT arrays_overlap(before, leader_before)"
            pairs = marked.join(chosen, "key").where(meets).select(F.col("leader_node").alias("a"), F.col("node").alias("b"))
        links = stored(linked(pairs, sets, percent), "links")
        members = tagged.select("key", "node")
        if met is not None:
            members = members.join(met, "node", "left_anti")
            leaders *= MORE_LEADERS
        if not links.isEmpty():
            own, other = labels.toDF("a", "la"), labels.toDF("b", "lb")
            edges = links.join(own, "a").join(other, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
            roots = star_forest(edges).toDF("label", "root")
            labels = stored(labels.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        ties = max(0, ties - 1)
        tagged = stored(members.join(labels, "node").select("key", "node", "label"), "buckets")
        tagged = stored(still_mixed(still_shared(stored(still_mixed(tagged), "mixed"))), "mixed")
    return labels


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept`` and
    ``text_hash``.

    ``component_id`` is the smallest doc_id of all documents reachable over links. Documents without
    words (null and empty texts) are linked with nothing, equal sets are linked. Null ids name
    no component: a component's id is null only where all its ids are, and one set of it is kept. Rows that
    repeat an id with another text are nodes of their own. Other columns of ``docs`` are left behind.
    """
    docs = docs.select("doc_id", "text")
    every = stored(signed(docs, size, bands, rows), "signatures")
    ids = every.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    # equal sets have equal bands, so one row of each node is enough
    nodes = every.where("node IS NOT NULL").join(ids, "node").where(every["doc_id"].eqNullSafe(ids["doc_id"])).select("node", "bands")
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = stored(still_shared(buckets.join(shared, "key").distinct()), "members")
    wanted = stored(ids.join(members.select("node").distinct(), "node").select("doc_id", "node"), "wanted")
    sets = shingle_sets(docs, wanted, size)
    labels = node_components(members, sets, percent)
    groups = ids.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    named = groups.join(groups.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select("node", "component_id", "label")
    out = every.select("doc_id", "text_hash", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    nameless = F.col("node").isNotNull() & F.col("component_id").isNull()
    kept = F.when(nameless, F.col("node") == F.col("label")).otherwise(component.eqNullSafe(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_hash")


def keep_first(spark, docs: DataFrame, sf_dir: str, size: int = 5, percent: int = 80) -> DataFrame:
    """Pipeline stage: of each component the document of the smallest id stays, whole rows.

    Documents without words are linked with nothing and stay. Of repeated rows of the kept id one stays;
    where all ids of a component are null, one of its rows.
    """
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    hashed = own.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    goes = near_duplicates(own, size, percent).where(~F.col("kept")).select(F.col("doc_id").alias("gone"), F.col("text_hash").alias("hash")).distinct()
    stays = hashed.join(goes, hashed["doc_id"].eqNullSafe(F.col("gone")) & (hashed["text_hash"] == F.col("hash")), "left_anti")
    wordless = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_hash", F.when(wordless, F.monotonically_increasing_id())).orderBy("lang", "source", "n_chars"))
    return stays.withColumn("nth", nth).where("nth = 1").drop("nth", "text_hash")


@query("op5_superminhash_dedup")
def op5(spark, sf_dir):
    """Near-duplicate components of all documents on four-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"))
