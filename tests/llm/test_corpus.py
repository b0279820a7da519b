"""Packing, sharding, near-dedup, decontamination, LM scoring, the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from skyledger.llm import decontamination, lm_scoring, near_dedup, packing, sharding
from skyledger.llm.base import fold, table
from skyledger.llm.shingles import WordHashes, shingles
from helpers_llm import DOCS, rows_of, words

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_ids_equal_those_of_the_tokenizer(spark, sf):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rng = random.Random(1)
    parts = ["the", " ", "  ", "\n", " \n", "\t", "Ü", "ñ", "don't", "42", "!!", "\x1f", "\x85", " ", "　", " ", "word", "\U0001f600", "<|endoftext|>", "'ll", "."]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 20))) for _ in range(2000)] + [r["text"] for r in table(spark, sf, "documents").limit(40).collect()]
    own = packing.encoder(VOCABULARY)
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.of(text), dtype="<u4").tolist() == want.ids, repr(text)


def test_packed_ids_equal_those_of_the_tokenizer_as_loaded(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    parts = ["the", " ", "  ", "\n", "Ü", "don't", "<|endoftext|>", "<|endoftext|>", "<|endof", "|>", "<|ENDOFTEXT|>", "."]
    texts = ["", "a <|endoftext|> b", "<|endoftext|>"] + ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in packing.pack(docs, with_ids=True).collect()}
    for i, want in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
        ids = np.array([*want.ids, packing.END_ID], dtype="<u4")
        assert bytes(got[i]["ids"]) == ids.tobytes() and got[i]["length"] == len(ids), texts[i]
        assert got[i]["ids_crc32"] == zlib.crc32(ids.tobytes())


def check_packed(rows, docs, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for sequence in by_sequence.values():
        at = 0
        for r in sorted(sequence, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return by_doc, by_sequence


def test_packing_is_whole_and_tight(spark, sf):
    docs = table(spark, sf, "documents")
    rows = packing.pack(docs, with_ids=True).collect()
    by_doc, by_sequence = check_packed(rows, docs, 1024)
    own = packing.encoder(VOCABULARY)
    for r in docs.collect():
        ids = own.of(r["text"]) + np.array([2], dtype="<u4").tobytes()
        parts = sorted(by_doc[r["doc_id"]], key=lambda p: p["piece"])
        assert b"".join(bytes(p["ids"]) for p in parts) == ids
        assert all(p["length"] == 1024 for p in parts[1:]) and [p["piece"] for p in parts] == list(range(len(parts)))
        for p in parts:
            assert p["ids_crc32"] == zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])])
    tokens = sum(r["length"] for r in rows)
    assert len(by_sequence) <= 1.01 * math.ceil(tokens / 1024) + 2


def test_packing_odd_rows(spark, odd_docs, no_docs):
    rows = packing.pack(odd_docs).collect()
    by_doc, _ = check_packed(rows, odd_docs, 1024)
    assert [r["length"] for r in by_doc[1]] == [1] and len(by_doc[4]) == 2 and len(by_doc[8]) > 100
    assert packing.pack(no_docs).count() == 0


def test_packing_plans_hold_for_any_histogram():
    rng = np.random.default_rng(0)
    for _ in range(12):
        counts = rng.integers(0, 40, 65) * (rng.random(65) < 0.4)
        counts[0] = 0
        plan = packing.rounded(counts, 64, packing.solve(counts, 64, rounds=60))
        left = counts.copy()
        for config, n in plan:
            assert sum(s * k for s, k in config.items()) <= 64 and n > 0
            for s, k in config.items():
                left[s] -= n * k
        assert not left.any()
        least = max(math.ceil((counts * np.arange(65)).sum() / 64), int(counts[33:].sum()))
        assert sum(n for _, n in plan) <= 1.15 * least + 3


def test_knapsack_matches_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        weights = rng.random(13) * (rng.random(13) < 0.6)
        weights[0] = 0
        best = [0.0] * 13
        for room in range(1, 13):
            best[room] = max([best[room - 1]] + [best[room - s] + weights[s] for s in range(1, room + 1)])
        config, value = packing.best_configuration(weights, 12)
        assert value == pytest.approx(best[12]) and sum(weights[s] * k for s, k in config.items()) == pytest.approx(value)


def test_shards_are_balanced_and_gapless(spark, sf, odd_docs, no_docs):
    docs = table(spark, sf, "documents")
    text = F.coalesce("text", F.lit(""))
    for df in (docs, odd_docs):
        rows = sharding.shard(df).collect()
        assert rows_of(df.select("doc_id", (F.octet_length(text) + 1).alias("s")), "doc_id", "s") == rows_of(spark.createDataFrame([(r["doc_id"], r["size"]) for r in rows], "doc_id long, s long"), "doc_id", "s")
        slots = {}
        for r in rows:
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    sizes = Counter()
    for r in sharding.shard(docs).collect():
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) <= 1.1 * sum(sizes.values()) / 16
    assert sharding.shard(no_docs).count() == 0


def test_hot_groups_are_split_and_others_stay_together(spark):
    rows = [(i, "the same text") for i in range(3000)] + [(5000 + i, f"text {i // 2}") for i in range(3000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes, by_text = Counter(), {}
    for r in out:
        sizes[r["shard"]] += r["size"]
        by_text.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert max(sizes.values()) <= 1.03 * min(sizes.values())
    assert all(len(s) == 1 for crc, s in by_text.items() if crc != zlib.crc32(b"the same text"))


def test_groups_that_fit_a_shard_are_not_split(spark, sf):
    docs = table(spark, sf, "documents")
    assert docs.groupBy("text").count().where("count > 1").count() > 0
    assert sharding.shard(docs).groupBy("text_crc32").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0
    text = "word " * 500
    rows = [(i, f"{text} {i // 40:02d}") for i in range(640)]  # 16 groups that fill a shard each
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("text_crc32").alias("g")).collect()
    assert [(r["n"], r["g"]) for r in out] == [(40, 1)] * 16


def test_placement_matches_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        vectors = rng.integers(1, 100, (30, 3)).astype(float)
        share = [sum(v[d] for v in vectors.tolist()) / 4 for d in range(3)]
        free, want = [[1.0] * 3 for _ in range(4)], {}
        for i in sorted(range(30), key=lambda i: -max(vectors[i][d] / share[d] * sharding.IMPORTANCE[d] ** 0.5 for d in range(3))):
            gain = [sum(free[s][d] * vectors[i][d] / share[d] * sharding.IMPORTANCE[d] for d in range(3)) for s in range(4)]
            want[i] = max(range(4), key=lambda s: gain[s])
            free[want[i]] = [free[want[i]][d] - vectors[i][d] / share[d] for d in range(3)]
        assert sharding.place(vectors, 4).tolist() == [want[i] for i in range(30)]


def test_signatures_estimate_similarity_and_step_order_is_free():
    rng = np.random.default_rng(0)
    for n in (1, 2, 9, 80, 900):
        errors = []
        for _ in range(20):
            base = rng.integers(0, 2**63, size=2 * n, dtype=np.uint64)
            a, b = np.unique(base[: int(1.5 * n)]), np.unique(base[n // 2 :])
            both = near_dedup.superminhash([a, b], 100)
            alone = near_dedup.superminhash([b], 100)
            assert (both[1] == alone[0]).all()
            errors.append((both[0] == both[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(errors)) < 0.05


def brute_components(rows, size, percent):
    """Smallest id of each row's component, by comparing all pairs."""
    hashes = WordHashes()
    sets = [frozenset(shingles(hashes.of(t or ""), size).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[root(i)] = min(low.get(root(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), low.get(root(i))) for i, (doc_id, _) in enumerate(rows)]


def chained(n, seed):
    """Texts that change a few words from one to the next, so that links form long chains."""
    rng = random.Random(seed)
    text = words(60, seed).split()
    out = []
    for i in range(n):
        text = list(text)
        text[rng.randrange(60)] = f"new{seed}{i}"
        out.append(" ".join(text))
    return out


def test_components_match_brute_force(spark, sf, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(chained(40, 1) + chained(25, 2))] + [(20_000 + i, words(60, 1)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(near_dedup.near_duplicates(df), "doc_id", "n_shingles", "component_id") == sorted(brute_components(rows, 4, 80), key=repr)
    odd = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert rows_of(near_dedup.near_duplicates(odd_docs), "doc_id", "n_shingles", "component_id") == sorted(brute_components(odd, 4, 80), key=repr)
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_star_forest_joins_long_paths(spark):
    chain = [(f"{i:03d}".encode(), f"{i + 1:03d}".encode()) for i in range(60) if i != 30]
    random.Random(0).shuffle(chain)
    out = near_dedup.star_forest(spark.createDataFrame(chain, "a binary, b binary").repartition(7))
    assert {(bytes(r["a"]), bytes(r["b"])) for r in out.collect()} == {(f"{i:03d}".encode(), b"000" if i <= 30 else b"031") for i in range(61) if i not in (0, 31)}


def test_star_rounds_give_what_one_task_gives(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL_EDGES", 0)
    test_star_forest_joins_long_paths(spark)


def changed(n, seed, edits):
    """Copies of one text, each with other words at ``edits`` random places."""
    rng = random.Random(seed)
    base = words(150, seed).split()
    return [" ".join(f"e{i}" + w if at in own else w for at, w in enumerate(base)) for i in range(n) for own in [set(rng.sample(range(150), edits))]]


def test_sketches_lose_no_link_and_tell_most_others(spark):
    hashes = WordHashes()
    sets = [shingles(hashes.of(t), 4) for edits in (1, 2, 3, 4, 6) for t in changed(25, 3, edits)] + [shingles(hashes.of(words(n, 3)), 4) for n in (1, 150, 9000)]
    sides = spark.createDataFrame([(i, len(s), near_dedup.parity_sketch(s).tolist()) for i, s in enumerate(sets)], "i int, n int, sketch array<bigint>")
    other = sides.selectExpr("i AS j", "n AS other_n", "sketch AS other_sketch")
    met = {(r["i"], r["j"]) for r in sides.join(other).where("i < j AND " + near_dedup.may_link("n", "sketch", "other_n", "other_sketch", 80)).collect()}
    share = {(i, j): 1.0 * len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) for j in range(len(sets)) for i in range(j)}
    assert met >= {p for p, v in share.items() if v >= 0.8}
    assert sum(v >= 0.8 for v in share.values()) > 500
    assert not met & {p for p, v in share.items() if v < 0.7}


def test_near_copies_without_links_are_no_pairs(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(changed(120, 5, 4) + changed(30, 5, 1))]
    counts = []
    linked = near_dedup.linked

    def noted(pairs, sets, percent):
        counts.append(pairs.distinct().count())
        return linked(pairs, sets, percent)

    monkeypatch.setattr(near_dedup, "linked", noted)
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(out, "doc_id", "n_shingles", "component_id") == sorted(brute_components(rows, 4, 80), key=repr)
    assert sum(counts) < 1500  # of 11,175 pairs; 7,140 are of copies that are not linked


def test_few_pairs_go_to_the_sets_and_many_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL_SETS", -1)
    sets = near_dedup.stored(spark.createDataFrame([(bytes([i]), list(range(i, i + 9))) for i in range(40)], "node binary, shingles array<bigint>"), "sets")
    pairs = near_dedup.stored(spark.createDataFrame([(bytes([i % 3]), bytes([i])) for i in range(3, 40)], "a binary, b binary"), "pairs")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, moves in ((100, False), (0, True)):
            monkeypatch.setattr(near_dedup, "SMALL_IDS", most)
            met = near_dedup.met_sets(pairs, sets, "shingles", 8)
            plan = met._jdf.queryExecution().executedPlan().toString()
            assert ("hashpartitioning(b#" in plan) == moves and "hashpartitioning(a#" in plan
            got = {(bytes(r["a"]), bytes(r["b"])): (r["sa"][0], r["sb"][0]) for r in met.collect()}
            assert got == {(bytes([i % 3]), bytes([i])): (i % 3, i) for i in range(3, 40)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shuffled_sets_and_ids_give_what_sent_ones_give(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL_IDS", 0)
    monkeypatch.setattr(near_dedup, "SMALL_SETS", -1)
    rows = [(i, t) for i, t in enumerate(chained(25, 4) + changed(30, 6, 4) + changed(12, 6, 1))]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(out, "doc_id", "n_shingles", "component_id") == sorted(brute_components(rows, 4, 80), key=repr)


def test_one_document_of_each_group_stays(spark, odd_docs):
    out = near_dedup.keep_first(spark, odd_docs, "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = rows_of(out, "doc_id", "text")
    assert [k for k in kept if (k[1] or "").lower() == "one two"] == [(4, "one two")]
    assert len([k for k in kept if not (k[1] or "").strip()]) == 4
    assert len([k for k in kept if k[0] == 6]) == 2 and not [k for k in kept if k[0] == 7]


def brute_contained(docs, items, size=5, percent=80):
    def grams(text, k):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    out = []
    for doc_id, text in docs:
        for item_id, item in items:
            k = min(size, len((item or "").split()))
            own = grams(item, k) if k else set()
            if own and 100 * len(own & grams(text, k)) >= percent * len(own):
                out.append((doc_id, item_id, len(own), len(own & grams(text, k))))
    return sorted(out, key=repr)


def test_containment_matches_brute_force(spark, sf, odd_docs):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    rng = random.Random(4)
    for i, (item_id, text) in enumerate(items):
        w = text.split()
        for drop in (0, 1, 2, 4):
            cut = w[: len(w) - drop * 2] if i % 2 else [x if rng.random() > 0.02 * drop else "zz" for x in w]
            docs.append((30_000 + 10 * i + drop, words(300, i) + " " + " ".join(cut).upper() + "\n" + words(50, i + 99)))
    items += [(900, "one two"), (901, None), (902, ""), (903, " ".join(docs[0][1].split()[:3]))]
    docs += [(r["doc_id"], r["text"]) for r in odd_docs.where("doc_id < 8").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    want = brute_contained(docs, items)
    assert len(want) > 60
    assert rows_of(decontamination.contained(df, bench), "doc_id", "item_id", "n_item", "n_shared") == want
    assert decontamination.contained(df, bench.limit(0)).count() == 0 and decontamination.contained(df.limit(0), bench).count() == 0


def test_contaminated_documents_go(spark, sf):
    item = table(spark, sf, "benchmark").first()["text"]
    docs = spark.createDataFrame([(1, words(80) + " " + item, "en", "s", 1), (2, words(80), None, None, None), (None, None, None, None, None)], DOCS)
    assert rows_of(decontamination.drop_contaminated(spark, docs, sf), "doc_id") == [(2,), (None,)]


def test_windows_score_each_id_once():
    for n in (1, 31, 32, 33, 64, 65, 200):
        ids = np.arange(n)
        x, y, scored = lm_scoring.windows(ids)
        assert y[scored].tolist() == ids.tolist()
        context = lm_scoring.WINDOW - lm_scoring.STRIDE
        assert (x[:, context + 1 :] == y[:, :-1])[scored[:, 1:] & (y[:, 1:] != lm_scoring.END)].all()
        assert x[0, context] == lm_scoring.BEGIN


def test_gradients_and_causality():
    rng = np.random.default_rng(0)
    samples = [np.append(rng.integers(0, 300, 100), lm_scoring.END) for _ in range(30)]
    counts = np.bincount(np.concatenate(samples), minlength=lm_scoring.VOCABULARY + 1)
    model = lm_scoring.fit(samples, counts, steps=0)
    x, y, scored = (np.concatenate(m) for m in zip(*[lm_scoring.windows(s) for s in samples[:2]], strict=True))
    _, grads = model.gradients(x, y, scored)
    rows = grads.pop("rows")
    for name, g in grads.items():
        place = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        at = (rows[place[0]], place[1]) if name == "embed" else place
        w, old, losses = model.weights[name], model.weights[name][at], []
        for step in (0.01, -0.01):
            w[at] = old + step
            losses.append(model.gradients(x, y, scored)[0])
        w[at] = old
        assert (losses[0] - losses[1]) / 0.02 == pytest.approx(float(g[place]), rel=0.1, abs=2e-4), name
    changed = x.copy()
    changed[:, 30] = 7
    before, after = model.forward(x)["log"], model.forward(changed)["log"]
    context = lm_scoring.WINDOW - lm_scoring.STRIDE
    assert np.allclose(before[:, : 30 - context], after[:, : 30 - context], atol=1e-5) and not np.allclose(before, after, atol=1e-3)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(1)
    samples = [np.append(np.tile(rng.integers(0, 200, 7), 20), lm_scoring.END) for _ in range(40)]
    counts = np.bincount(np.concatenate(samples), minlength=lm_scoring.VOCABULARY + 1)
    raw, fitted = lm_scoring.fit(samples, counts, steps=0), lm_scoring.fit(samples, counts, steps=150)
    held = samples[:5]
    total = lambda m: sum(s.sum() for s in lm_scoring.score_ids(m, held))
    assert total(fitted) > total(raw)
    near = lm_scoring.score_ids(fitted, [held[0]])[0]
    assert np.allclose(near, lm_scoring.score_ids(fitted, [held[1], held[0]])[1], atol=1e-4)


def test_all_training_documents_train_the_model(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "PART_WINDOWS", 40)
    path = lm_scoring.public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = [(i, " ".join(f"word{(i * 7 + j) % 31}" for j in range(90))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    samples = [lm_scoring.read_ids(r["ids"]) for r in lm_scoring.corpus_ids(docs, path).collect()]
    counts = np.bincount(np.concatenate(samples), minlength=lm_scoring.VOCABULARY + 1)
    assert (lm_scoring.id_counts(lm_scoring.word_counts(docs), path) == counts).all()
    frequent = lm_scoring.frequent_ids(counts)
    joined = np.concatenate([np.concatenate(([lm_scoring.BEGIN], s)) for s in samples])
    brute = np.bincount(lm_scoring.neighbour_places(joined, frequent), minlength=len(frequent) * 2 * lm_scoring.NEIGHBOURS)
    assert (lm_scoring.corpus_neighbours(lm_scoring.corpus_ids(docs.repartition(5), path), counts).reshape(-1) == brute).all()
    seen = []
    trained = lm_scoring.trained

    def noted(model, dealt, steps, peak):
        seen.append(sorted((r["doc_id"], r["part"]) for r in dealt.collect()))
        return trained(model, dealt, steps, peak)

    monkeypatch.setattr(lm_scoring, "trained", noted)
    one, other = (lm_scoring.fit_corpus(docs.repartition(n), counts, path, steps=30) for n in (1, 5))
    assert [i for i, _ in seen[1]] == list(range(60)) and len({p for _, p in seen[1]}) > 5  # every document, in many parts
    assert {p for _, p in seen[0]} == {0} and seen[:2] == seen[2:]
    for name, w in one.weights.items():
        assert np.allclose(w, other.weights[name], atol=1e-5), name
    total = lambda m: sum(s.sum() for s in lm_scoring.score_ids(m, samples))
    assert total(one) > total(lm_scoring.fit(samples, counts, steps=0))


def test_base_scores_match_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FREQUENT_WORDS", 300)  # most words take the join
    docs = table(spark, sf, "documents").unionByName(spark.createDataFrame([(7001, None), (7002, ""), (7003, "NEWWORD neverseen")], "doc_id long, text string"), allowMissingColumns=True)
    out = {r["doc_id"]: r for r in lm_scoring.score(docs, docs.where(fold(7) != 2), steps=20).collect()}
    rows = [(r["doc_id"], lm_scoring.split(r["text"] or "") + [b""]) for r in docs.collect()]
    counts = Counter(w for i, ws in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in rows:
        r = out[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_scores_do_not_depend_on_the_words_sent_to_tasks(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents")
    whole = rows_of(lm_scoring.score(docs, docs.where(fold(7) != 2), steps=5), "doc_id", "n_known", "score")
    monkeypatch.setattr(lm_scoring, "FREQUENT_WORDS", 300)  # most words take the join
    joined = rows_of(lm_scoring.score(docs, docs.where(fold(7) != 2), steps=5), "doc_id", "n_known", "score")
    for (doc_id, known, score), (other_id, other_known, other) in zip(whole, joined, strict=True):
        assert (doc_id, known) == (other_id, other_known) and score == pytest.approx(other, rel=1e-6)


def test_scores_of_odd_rows(spark, odd_docs, no_docs):
    out = lm_scoring.score(odd_docs, odd_docs, steps=5)
    assert out.count() == odd_docs.count()
    assert {r["n_tokens"] for r in out.where("doc_id IN (1, 2, 3)").collect()} == {1}
    assert lm_scoring.score(no_docs, no_docs, steps=1).count() == 0
    bare = lm_scoring.score(odd_docs, no_docs, steps=1).collect()
    assert {r["base_score"] for r in bare} == {0.0} and {r["n_known"] for r in bare} == {0}


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "secret_scan", "packing"]
    out = corpus_pipeline.run(spark, sf)
    packed = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    low = {i: c for i, _, c in brute_components(rows, 5, 80)}
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    first = [(i, t) for i, t in rows if low[i] in (i, None)]
    bad = {i for i, *_ in brute_contained(first, items)}
    assert packed == {i for i, _ in first} - bad
