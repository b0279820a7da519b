"""Chat formatting, periodic runs and hard negatives against brute force, round trips and SQL."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from skyledger.llm import chat_formatting as C
from skyledger.llm import hard_negatives as H
from skyledger.llm import periodic_runs as P

TURNS = "conv_id long, turn long, role string, text string, head string, body string, reply string, example string"
ODD = ["<turn assistant>\n", "</turn>\n", "\\", "\\\\", "<", "/turn", "<\\turn", "a>b", "\n", "", "ß\U0001f600", "turn ok"]


def turn(conv, at, role, text):
    return (conv, at, role, text, "clash", "clash", "clash", "clash")


def brute_digests(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        said = [(role, text) for _, _, role, text in own]
        loss = "".join(text for role, text in said if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for role, text in said)
        out[conv] = (len(said), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip_over_odd_turns(spark):
    rng = random.Random(4)
    rows = [turn(None, 0, "user", "no id"), turn(None, 1, "assistant", "reply"), turn(1, 0, None, None), turn(2, None, "assistant", None)]
    rows += [turn(3, 0, "assistant", "same")] * 2 + [turn(3, 0, "user", "tie"), turn(4, 0, "user", "x" * 300_000), turn(4, 1, "assistant", "y" * 300_000)]
    for conv in range(10, 150):
        for at in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "assistant", "system", "</turn>\n", "a>\\>b\n"])
            rows.append(turn(conv, at, role, "".join(rng.choices(ODD, k=rng.randint(0, 6)))))
    examples = C.prefix_examples(spark.createDataFrame(rows, TURNS))
    found = {r["conv_id"]: r for r in C.conversation_digests(examples).collect()}
    expected = brute_digests(rows)
    assert found.keys() == expected.keys()
    assert {k: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for k, r in found.items()} == expected


def test_every_reply_is_an_example_with_its_context(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "user", "v"), (1, 4, "assistant", "b"), (1, 5, "user", "w"), (2, 0, "user", "only")]
    out = C.prefix_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "example").collect()
    assert [[t for _, t in C.read_turns(r["text"])] for r in out] == [["s", "u", "a"], ["s", "u", "a", "v", "b"], ["s", "u", "a", "v", "b", "w"], ["only"]]
    assert [r["text"][r["loss_start"] : r["loss_end"]] if r["loss_end"] else None for r in out] == ["a", "b", None, None]
    with pytest.raises(ValueError):
        list(C.read_turns("no turn"))


def test_chat_empty_table(spark):
    none = spark.createDataFrame([], TURNS)
    assert C.prefix_examples(none).count() == 0 and C.conversation_digests(C.prefix_examples(none)).count() == 0


def brute_runs(w):
    out, n = set(), len(w)
    for p in range(1, n):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            s, e = i, j + p
            if j > i and e - s >= max(6, 4 * p) and not any(all(w[x] == w[x + q] for x in range(s, e - q)) for q in range(1, p)):
                out.add((s, e - s, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    n, k = rng.randint(0, 80), rng.randint(1, 4)
    w = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.7:
        a = rng.randrange(n)
        p = 1 + (n - a) // (3 + rng.randrange(8))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_runs_match_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        w = repetitive(rng)
        assert P.find_runs(np.array(w, dtype=np.int64)) == brute_runs(w)


def test_long_run_of_a_very_long_text():
    w = np.concatenate([np.arange(50_000), np.tile(np.arange(7_000), 9), [3], np.zeros(200_000, dtype=np.int64)])
    assert P.find_runs(w) == [(50_000, 63_000, 7_000), (113_001, 200_000, 1)]


def brute_document(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *facts, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(kept)))


def test_run_digests_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, " \x0b".join(f"w{x}" for x in repetitive(rng)) + rng.choice(["", "\x1f", " é"]), "clash", "clash") for i in range(400)]
    rows += [(500, None, None, None), (501, "", None, None), (502, " \t\n", None, None), (None, "a a a a a a b", None, None), (3, "x y " * 9, None, None), (3, "x y " * 9, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, _words string")
    out = P.run_digests(P.periodic_runs(P.with_planted_runs(docs)))
    assert sum(1 for r in out.collect() if r["n_runs"]) > 50
    assert sorted(map(tuple, out.collect()), key=repr) == sorted((brute_document(r[0], r[1]) for r in rows), key=repr)
    assert P.run_digests(P.periodic_runs(docs.limit(0))).count() == 0


def brute_negatives(rows, every):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    d = max((len(r[1]) for r in rows), default=0)
    data = [(i, [int(np.floor(256 * float(x))) for x in v] + [0] * (d - len(v)), label) for i, v, label in rows]
    anchors = {}
    for i, v, label in sorted(data, key=lambda r: (r[0], r[2], r[1])):
        if i % every == 0:
            anchors.setdefault(i, (v, label))
    out = []
    for a, (v, label) in anchors.items():
        dots = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, w, other in data if i != a)
        for s, p, _ in [x for x in dots if x[2]][:5]:
            fit = [(i, t) for t, i, same in dots if not same and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(a, p, k, i, -s, -t) for k, (i, t) in enumerate(fit, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, vector string, code string, align string, rest string, positives string"


def negatives(spark, rows, every):
    df = spark.createDataFrame([(*r, "clash", "clash", "clash", "clash", "clash") for r in rows], VECTORS)
    out = H.hard_negatives(df, every)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in out.collect())


def test_hard_negatives_match_brute_force(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(4, 12))
    rows = [(i, [float(np.float32(x)) for x in (centre[i % 4] * 0.1 + rng.normal(size=12) * 0.2)], int(rng.integers(0, 4))) for i in range(2500)]
    # one vector that a third of the rows share, ties, gaps, short vectors
    rows = [(i, rows[0][1], label) if i % 3 == 1 else (i, v, label) for i, v, label in rows]
    rows += [(3000, None, 1), (3001, rows[1][1], None), (None, rows[1][1], 1), (3002, [float("nan")] * 12, 1), (3003, [None] * 12, 1), (3004, [float("inf")] * 12, 1)]
    rows += [(3100, [0.5, 0.25], 1), (3200, [], 2), (3300, [0.0] * 12, 3)]
    assert negatives(spark, rows, 100) == brute_negatives(rows, 100)


def test_hard_negatives_of_few_and_repeated_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.1], 1), (2, [0.45, 0.3], 2), (2, [0.45, 0.3], 2), (4, [-1.0, 0.0], 2), (10, [-1.0, 0.5], 3)]
    found = negatives(spark, rows, 10)
    assert found == brute_negatives(rows, 10) == [(0, 1, 1, 2, 32768, 29440), (0, 1, 2, 2, 32768, 29440)]
    assert negatives(spark, [], 10) == []


def test_hard_negatives_count_rows_where_ids_repeat(spark):
    rng = np.random.default_rng(8)
    rows = [(i % 60, [float(np.float32(x)) for x in rng.normal(size=4) + 1], int(rng.integers(0, 3))) for i in range(90)]
    rows += rows[:40] + [(0, rows[0][1], 7)]
    data = [(i, [int(np.floor(256 * x)) for x in v], label) for i, v, label in rows]
    expected = []
    for a, (anchor, v, label) in enumerate(data):
        if anchor % 10 == 0:
            dots = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for b, (i, w, other) in enumerate(data) if b != a)
            for s, p, _ in [x for x in dots if x[2]][:5]:
                fit = [(i, t) for t, i, same in dots if not same and 80 * -s <= 100 * -t <= 100 * -s][:5]
                expected += [(anchor, p, k, i, -s, -t) for k, (i, t) in enumerate(fit, 1)]
    assert negatives(spark, rows, 10) == sorted(expected)


@pytest.mark.parametrize("d", [1, 5, 64, 70])
def test_intervals_hold_and_filter(d):
    rng = np.random.default_rng(d)
    rows = rng.integers(-300, 300, size=(500, d))
    turn_ = H.rotation(d)
    codes, align, rest = H.encode(rows, turn_)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    for vector in (rows[0], rng.integers(-5, 5, size=d), np.zeros(d, dtype=np.int64)):
        low, high = H.Prepared(vector, turn_).intervals(codes, ones, align, rest)
        exact = rows @ vector
        assert (low <= exact).all() and (exact <= high).all()
    if d == 64:  # the interval is a good deal narrower than the plain product of lengths
        width = np.median(high - low) if vector.any() else np.median(np.subtract(*H.Prepared(rows[0], turn_).intervals(codes, ones, align, rest)[::-1]))
        assert width < 1.5 * np.linalg.norm(rows[0]) * np.median(np.linalg.norm(rows, axis=1))


def test_scores_stay_exact_for_large_numbers():
    rows = np.array([[2**40, 3], [5, 7]])
    assert list(H.scores(rows, np.array([2**40, 1]))) == [2**80 + 3, 5 * 2**40 + 7]
    assert list(H.scores(rows, np.array([2**15, 1]))) == [2**55 + 3, 5 * 2**15 + 7]


@pytest.mark.parametrize("name", ["op11_chat_formatting", "op13_hard_negatives"])
def test_queries_match_their_sql(spark, sf, name):
    import duckdb

    from skyledger.llm.base import ORACLES, QUERIES

    out = QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    sql = ORACLES[name]
    if name == "op13_hard_negatives":
        assert "CASE WHEN vec_id % 7" in sql
    found = con.execute(f"SELECT {', '.join(out.columns)} FROM ({sql})").fetchall()
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(found, key=repr)


def test_run_query_matches_brute_force_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = [tuple(r) for r in docs if len((r["text"] or "").split()) < 600]
    found = {r["doc_id"]: tuple(r) for r in P.op12(spark, sf).collect()}
    assert len(found) == len(docs)
    assert [found[i] for i, _ in short] == [brute_document(i, text) for i, text in short]


def test_links_by_bits_and_full_sets_equal_brute_force(spark):
    from skyledger.llm import near_dedup as N

    rng = np.random.default_rng(9)
    sets = {}
    for i in range(60):
        # families of sets around the limit; one family so large that low bits collide
        n = 400 if i < 40 else 30_000
        base = np.random.default_rng(i % 8 if i < 40 else 99).integers(-(2**62), 2**62, n)
        keep = base[rng.random(n) < rng.uniform(0.8, 1.0)]
        sets[bytes([i])] = np.unique(np.concatenate([keep, rng.integers(-(2**62), 2**62, int(n * rng.uniform(0, 0.15)))]))
    rows = [(bytearray(k), v.tolist(), len(v), np.unique(v.view(np.uint64).astype(np.uint16)).view(np.int16).tolist()) for k, v in sets.items()]
    frame = spark.createDataFrame(rows, "node binary, shingles array<bigint>, n int, low array<smallint>")
    nodes = sorted(sets)
    pairs = [(a, b) for a in nodes for b in nodes if a < b and (a[0] < 40) == (b[0] < 40)]
    found = N.linked(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in pairs], "a binary, b binary"), frame, 80)
    common = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a, b in pairs}
    want = {(a, b) for (a, b), c in common.items() if c * 100 >= 80 * (len(sets[a]) + len(sets[b]) - c)}
    assert {(bytes(r["a"]), bytes(r["b"])) for r in found.collect()} == want and 20 < len(want) < len(pairs) - 20
