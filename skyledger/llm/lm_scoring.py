"""LM scoring with a causal self-attention model trained in numpy on subword ids.

The text is its lower-cased words and one end. Two scores come out of one pass over the corpus:

* base: add-one word unigrams over all training documents. Word counts are map-side combined; the most
  frequent words (a fixed number) are known to every task, all others meet the counts in a join.
* model: subword ids of the words in overlapping windows. A one-layer causal attention model gives the
  class of the next subword, the training counts of all documents give the subword within its class.
  A word's probability is half that of its subwords and, for words of the training documents, half its
  unigram; words that tasks don't know get theirs in the same join. Counts, classes and attention weights come from
  all training documents: after a start on one part of them, every part is trained on by a task of its own, and the weights are averaged.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.base import fold, map_batches, query, stored, table, texts
from skyledger.llm.packing import REMEMBERED, encoder

#: Ids of the vocabulary, then one that ends a text and one that begins it.
VOCABULARY = 50257
END, BEGIN = VOCABULARY, VOCABULARY + 1
#: A window's length, and how many of its last tokens it scores; the others are context.
WINDOW, STRIDE = 48, 32
WIDTH, HIDDEN, CLASSES = 16, 32, 64
#: The attention weights are trained in at least so many steps of so many windows; a small corpus is passed several times.
STEPS, STEP_WINDOWS = 1200, 48
#: About so many windows of the training documents are a part, which one task trains on.
PART_WINDOWS = 1 << 16
#: Highest rates of the first part's steps and of the steps from its weights on.
RATE, LATER_RATE = 0.02, 0.004
#: Ids that are put into classes by their neighbours, and how many of these count as neighbours.
FREQUENT_IDS, NEIGHBOURS = 4000, 512
#: So many of the most frequent words are sent to all tasks.
FREQUENT_WORDS = 1 << 17
#: Words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Windows that are scored at a time.
SCORED_WINDOWS = 16


def split(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class WordIds(dict):
    """Subword ids of a word behind a space, as bytes of 16-bit numbers, remembered by word."""

    def __init__(self, path: str):
        self.encode = encoder(path).encoding.encode_ordinary

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = np.array(self.encode(" " + word.decode("utf-8", "replace")), dtype=np.uint16).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text's words and the end, and where each word and the end begin."""
        own = list(map(self.__getitem__, words))
        ids = np.frombuffer(b"".join(own), dtype=np.uint16)
        ends = np.cumsum(np.fromiter(map(len, own), dtype=np.int64, count=len(own))) // 2
        return np.concatenate((ids.astype(np.int64), [END])), np.concatenate(([0], ends))


def windows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and which targets are scored, one row for each window; every id is scored once.

    A window's inputs are WINDOW ids, its targets what follows the last STRIDE of them. The first
    window's context are begin marks.
    """
    n, context = len(ids), WINDOW - STRIDE
    count = -(-n // STRIDE)
    padded = np.full(context + 1 + count * STRIDE, END)
    padded[: context + 1], padded[context + 1 : context + 1 + n] = BEGIN, ids
    start = np.arange(count)[:, None] * STRIDE
    return padded[start + np.arange(WINDOW)], padded[start + np.arange(context + 1, WINDOW + 1)], start + np.arange(STRIDE) < n


@dataclass
class Model:
    """Weights by name, the class of each id and the log probability of each id within its class."""

    weights: dict[str, np.ndarray]
    classes: np.ndarray
    inside: np.ndarray
    made: dict[str, np.ndarray] = field(default_factory=dict)

    def forward(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """All layers for windows of ids, with the log probabilities of classes as ``log``."""
        w = self.weights
        e = w["embed"][x]
        last = e[:, WINDOW - STRIDE :]
        q, k, v = last @ w["q"], e @ w["k"], e @ w["v"]
        score = q @ k.transpose(0, 2, 1)
        score *= 1 / math.sqrt(WIDTH)
        score += spread(w["near"])  # minus infinity ahead of a position: causal
        score -= score.max(axis=2, keepdims=True)
        p = np.exp(score, out=score)
        p /= p.sum(axis=2, keepdims=True)
        a = p @ v
        h = last + a @ w["o"]
        u = np.maximum(h @ w["w1"] + w["b1"], 0)
        g = h + u @ w["w2"]
        z = g @ w["c"] + w["bc"]
        z -= z.max(axis=2, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=2, keepdims=True))
        return {"e": e, "last": last, "q": q, "k": k, "v": v, "p": p, "a": a, "h": h, "u": u, "g": g, "log": z}

    def tables(self) -> dict[str, np.ndarray]:
        """For scoring: an id's vector, query, key and value side by side, the value followed by a 1."""
        if "all" not in self.made:
            w = self.weights
            e = w["embed"]
            parts = (e, e @ w["q"] / math.sqrt(WIDTH), e @ w["k"], e @ w["v"], np.ones((len(e), 1)))
            self.made["all"] = np.concatenate(parts, axis=1).astype(np.float32)
            self.made["near"] = spread(w["near"])
            self.made["ones"] = np.ones(CLASSES, dtype=np.float32)
        return self.made

    def log10(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """log10 of the probability of each target.

        The layers of ``forward`` with fewer passes over memory: exponents are taken as they are, sums come
        out of the products. Should a sum leave the range of numbers, the slower way decides.
        """
        w, t = self.weights, self.tables()
        own = t["all"][x]
        last, q = own[:, WINDOW - STRIDE :, :WIDTH], own[:, WINDOW - STRIDE :, WIDTH : 2 * WIDTH]
        k, v = own[:, :, 2 * WIDTH : 3 * WIDTH], own[:, :, 3 * WIDTH :]
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            score = q @ k.transpose(0, 2, 1)
            score += t["near"]
            np.exp(score, out=score)
            a = (score @ v).reshape(-1, WIDTH + 1)
            h = last.reshape(-1, WIDTH) + (a[:, :WIDTH] / a[:, WIDTH:]) @ w["o"]
            u = h @ w["w1"]
            u += w["b1"]
            np.maximum(u, 0, out=u)
            z = (h + u @ w["w2"]) @ w["c"]
            z += w["bc"]
            target = y.reshape(-1)
            log = z[np.arange(len(z)), self.classes[target]]
            np.exp(z, out=z)
            log -= np.log(z @ t["ones"])
        if not np.isfinite(log).all():
            log = np.take_along_axis(self.forward(x)["log"], self.classes[y][:, :, None], axis=2).reshape(-1)
        return ((log + self.inside[target]) / np.float32(math.log(10))).reshape(y.shape)

    def gradients(self, x: np.ndarray, y: np.ndarray, scored: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the classes of the scored targets, and its gradient by weight."""
        w, f = self.weights, self.forward(x)
        flat = lambda m: m.reshape(-1, m.shape[-1])
        target = self.classes[y]
        n = max(1, int(scored.sum()))
        loss = -float((np.take_along_axis(f["log"], target[:, :, None], axis=2)[:, :, 0] * scored).sum()) / n
        dz = np.exp(f["log"])
        np.put_along_axis(dz, target[:, :, None], np.take_along_axis(dz, target[:, :, None], axis=2) - 1, axis=2)
        dz *= scored[:, :, None] / n
        out = {"c": flat(f["g"]).T @ flat(dz), "bc": flat(dz).sum(axis=0)}
        dg = dz @ w["c"].T
        out["w2"] = flat(f["u"]).T @ flat(dg)
        du = (dg @ w["w2"].T) * (f["u"] > 0)
        out["w1"], out["b1"] = flat(f["h"]).T @ flat(du), flat(du).sum(axis=0)
        dh = dg + du @ w["w1"].T
        out["o"] = flat(f["a"]).T @ flat(dh)
        da = dh @ w["o"].T
        dp = da @ f["v"].transpose(0, 2, 1)
        dv = f["p"].transpose(0, 2, 1) @ da
        ds = f["p"] * (dp - (dp * f["p"]).sum(axis=2, keepdims=True))
        total = ds.sum(axis=0)
        out["near"] = np.array([np.trace(total, offset=WINDOW - STRIDE - i) for i in range(WINDOW)], dtype=np.float32)
        dq = ds @ f["k"] / math.sqrt(WIDTH)
        dk = ds.transpose(0, 2, 1) @ f["q"] / math.sqrt(WIDTH)
        de = dk @ w["k"].T + dv @ w["v"].T
        de[:, WINDOW - STRIDE :] += dh + dq @ w["q"].T
        out |= {name: flat(f[of]).T @ flat(d) for name, of, d in (("q", "last", dq), ("k", "e", dk), ("v", "e", dv))}
        rows, inverse = np.unique(x, return_inverse=True)
        summed = np.zeros((len(rows), WIDTH), dtype=np.float32)
        np.add.at(summed, inverse.reshape(-1), flat(de))
        out["embed"] = summed
        out["rows"] = rows
        return loss, out


def spread(near: np.ndarray) -> np.ndarray:
    """The bias by distance as a matrix (scored position, input), minus infinity ahead of the position."""
    lag = np.arange(WINDOW - STRIDE, WINDOW)[:, None] - np.arange(WINDOW)
    return np.where(lag >= 0, near[np.maximum(lag, 0)], np.float32(-1e9)).astype(np.float32)


def frequent_ids(counts: np.ndarray) -> np.ndarray:
    """The most frequent ids, the end apart."""
    frequent = np.argsort(-counts[:VOCABULARY], kind="stable")[:FREQUENT_IDS]
    return frequent[counts[frequent] > 0]


def neighbour_places(ids: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Where each id's neighbours count in a table of frequent ids by what stands before and after them, row by row."""
    place = np.full(VOCABULARY + 2, -1)
    place[frequent] = np.arange(len(frequent))
    before, after = place[ids[:-1]], place[ids[1:]]
    left = (after >= 0) & (before >= 0) & (before < NEIGHBOURS)
    right = (before >= 0) & (after >= 0) & (after < NEIGHBOURS)
    wide = 2 * NEIGHBOURS
    return np.concatenate((after[left] * wide + before[left], before[right] * wide + NEIGHBOURS + after[right]))


def classes_of(neighbours: np.ndarray, counts: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Classes of ids by k-means on the leading components of what stands before and after them (``neighbours``: a row
    for each of ``frequent_ids``), and the first WIDTH components as starting vectors.

    Ids outside the most frequent ones are dealt into two classes; the end has a class of its own.
    """
    classes = np.where(np.arange(VOCABULARY + 1) % 2, CLASSES - 2, CLASSES - 3)
    classes[END] = CLASSES - 1
    vectors_of = (np.random.default_rng(seed).standard_normal((VOCABULARY + 2, WIDTH)) * 0.2).astype(np.float32)
    frequent = frequent_ids(counts)
    if len(frequent) <= CLASSES:
        classes[frequent] = np.arange(len(frequent)) % (CLASSES - 3)
        return classes, vectors_of
    table_ = neighbours.astype(np.float32)
    table_ = np.sqrt(table_ / np.maximum(table_.sum(axis=1, keepdims=True), 1))
    values, vectors = np.linalg.eigh(table_.T @ table_)
    points = table_ @ vectors[:, -32:]
    rng = np.random.default_rng(seed)
    k = CLASSES - 3
    centres = points[np.concatenate((np.arange(k // 2), rng.choice(len(points), k - k // 2, replace=False)))].copy()
    own = np.zeros(len(points), dtype=np.int64)
    for _ in range(15):
        own = np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)
        for c in range(k):
            if (own == c).any():
                weight = counts[frequent[own == c]]
                centres[c] = np.average(points[own == c], axis=0, weights=weight)
    classes[frequent] = own
    leading = points[:, -WIDTH:]
    vectors_of[frequent] = leading / np.maximum(leading.std(axis=0), 1e-6) * 0.5
    return classes, vectors_of


def untrained(neighbours: np.ndarray, counts: np.ndarray, seed: int = 1) -> Model:
    """The model before its first step, from neighbour counts and the id ``counts`` of the whole training corpus."""
    rng = np.random.default_rng(seed)
    classes, vectors_of = classes_of(neighbours, counts)
    in_class = np.bincount(classes, weights=counts[: VOCABULARY + 1] + 1.0, minlength=CLASSES)
    inside = np.log((counts[: VOCABULARY + 1] + 1.0) / in_class[classes]).astype(np.float32)
    scale = lambda *s: (rng.standard_normal(s) / math.sqrt(s[0])).astype(np.float32)
    weights = {"embed": vectors_of}
    weights |= {"q": scale(WIDTH, WIDTH), "k": scale(WIDTH, WIDTH), "v": scale(WIDTH, WIDTH), "o": scale(WIDTH, WIDTH) * 0.5}
    weights |= {"w1": scale(WIDTH, HIDDEN), "b1": np.zeros(HIDDEN, dtype=np.float32), "w2": scale(HIDDEN, WIDTH) * 0.5}
    start = np.log((in_class + 1) / (in_class + 1).sum()).astype(np.float32)
    weights |= {"c": scale(WIDTH, CLASSES) * 0.3, "bc": start, "near": (-0.05 * np.arange(WINDOW)).astype(np.float32)}
    return Model(weights, classes, inside)


def train(model: Model, ids: list[np.ndarray], steps: int, peak: float = RATE, seed: int = 1) -> np.ndarray:
    """Train the weights in place on the windows of id sequences (numpy, Adam): the ids that are seen as inputs.

    Steps go through all windows in random order, then through all again.
    """
    weights, rng = model.weights, np.random.default_rng(seed)
    x, y, scored = (np.concatenate(m) for m in zip(*[[w.astype(np.int32) for w in windows(s)] for s in ids], strict=True))
    first = {n: np.zeros_like(w) for n, w in weights.items()}
    second = {n: np.zeros_like(w) for n, w in weights.items()}
    order = np.zeros(0, dtype=np.int64)
    for step in range(1, steps + 1):
        if not len(order):
            order = rng.permutation(len(x))
        at, order = order[:STEP_WINDOWS], order[STEP_WINDOWS:]
        _, grads = model.gradients(x[at], y[at], scored[at])
        rows = grads.pop("rows")
        rate = peak * min(1.0, step / 20) * (1 - step / (steps + 1)) + peak / 200
        for name, g in grads.items():
            here = rows if name == "embed" else slice(None)
            m = first[name][here] = 0.9 * first[name][here] + 0.1 * g
            v = second[name][here] = 0.99 * second[name][here] + 0.01 * g * g
            weights[name][here] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return np.unique(x)


def fit(samples: list[np.ndarray], counts: np.ndarray, steps: int = STEPS, seed: int = 1) -> Model:
    """A model of id sequences and their id ``counts``, trained in this process."""
    frequent = frequent_ids(counts)
    joined = np.concatenate([np.concatenate(([BEGIN], s)) for s in samples]) if samples else np.array([BEGIN, END])
    size = len(frequent) * 2 * NEIGHBOURS
    model = untrained(np.bincount(neighbour_places(joined, frequent), minlength=size).reshape(len(frequent), -1), counts, seed)
    if samples:
        train(model, samples, steps, seed=seed)
    return model


def corpus_ids(training: DataFrame, path: str) -> DataFrame:
    """``doc_id``, subword ``ids`` (16-bit numbers) of the whole text and its number of ``windows``."""

    def run(batches):
        words = WordIds(path)
        for batch in batches:
            found = [words.of(split(text))[0] for text in batch["text"]]
            yield {"doc_id": batch["doc_id"], "ids": [f.astype(np.uint16).tobytes() for f in found], "windows": [-(-len(f) // STRIDE) for f in found]}

    return map_batches(texts(training), run, "doc_id long, ids binary, windows long")


def read_ids(own: bytes) -> np.ndarray:
    return np.frombuffer(own, dtype=np.uint16).astype(np.int64)


def corpus_neighbours(corpus: DataFrame, counts: np.ndarray) -> np.ndarray:
    """Neighbour counts of the frequent ids over all of ``corpus_ids``; at most FREQUENT_IDS rows of 2 * NEIGHBOURS numbers."""
    frequent = frequent_ids(counts)
    size = len(frequent) * 2 * NEIGHBOURS

    def count(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            joined = np.concatenate([np.concatenate(([BEGIN], read_ids(own))) for own in batch["ids"]])
            np.add.at(total, neighbour_places(joined, frequent), 1)
        seen = np.nonzero(total)[0]
        for i in range(0, len(seen), HELD_WORDS):
            yield {"place": seen[i : i + HELD_WORDS], "n": total[seen[i : i + HELD_WORDS]]}

    rows = map_batches(corpus.select("ids"), count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, dtype=np.int64)
    out[rows["place"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy()
    return out.reshape(len(frequent), 2 * NEIGHBOURS)


def trained(model: Model, dealt: DataFrame, steps: int, peak: float) -> Model:
    """The model trained on from its weights on each part of ``dealt`` (``part``, ``ids``; a part in one task, in order), averaged.

    A part takes as many steps as pass all its windows, at least ``steps``. Weights count by the parts' windows, an id's vector by
    those that met the id.
    """
    sent = dealt.sparkSession.sparkContext.broadcast(model)

    def one(part, ids):
        own = Model({name: w.copy() for name, w in sent.value.weights.items()}, sent.value.classes, sent.value.inside)
        n = sum(-(-len(i) // STRIDE) for i in ids)
        met = train(own, ids, max(steps, -(-n // STEP_WINDOWS)), peak, part + 1)
        for name, w in own.weights.items():
            rows = met if name == "embed" else np.arange(len(np.atleast_2d(w)))
            yield {"name": [name] * len(rows), "row": rows, "own": list(np.atleast_2d(w)[rows]), "n": [n] * len(rows)}

    def run(batches):
        part, held = None, []
        for batch in batches:
            for at, ids in zip(batch["part"], batch["ids"], strict=True):
                if at != part and held:
                    yield from one(part, held)
                    held = []
                part = at
                held.append(read_ids(ids))
        if held:
            yield from one(part, held)

    rows = map_batches(dealt.select("part", "ids"), run, "name string, row int, own array<float>, n long")
    sums = [F.sum(F.get("own", F.lit(i)).cast("double") * F.col("n")) / F.sum("n") for i in range(max(WIDTH, HIDDEN, CLASSES, WINDOW))]
    means = F.filter(F.array(*sums), lambda v: v.isNotNull()).cast("array<float>")
    found = rows.groupBy("name", "row").agg(means.alias("mean")).toPandas()  # a row for each id and row of a weight
    weights = {name: w.copy() for name, w in model.weights.items()}
    for name, own in found.groupby("name"):
        np.atleast_2d(weights[name])[own["row"].to_numpy()] = np.stack(own["mean"].to_list())
    return Model(weights, model.classes, model.inside)


def fit_corpus(training: DataFrame, counts: np.ndarray, path: str, steps: int = STEPS) -> Model:
    """A model of all training documents. Parts depend on the rows alone, not on how they are stored."""
    corpus = stored(corpus_ids(training, path), "ids")
    model = untrained(corpus_neighbours(corpus, counts), counts)
    n = corpus.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    parts = max(1, n // PART_WINDOWS)
    part = F.pmod(F.xxhash64("doc_id", "ids"), F.lit(parts)).cast("int").alias("part")
    corpus = corpus.select(part, "doc_id", "ids")

    def ordered(rows, tasks):
        return rows.repartitionByRange(tasks, "part").sortWithinPartitions("part", "doc_id", "ids")

    model = trained(model, ordered(corpus.where("part = 0"), 1), steps, RATE)
    return model if parts == 1 else trained(model, ordered(corpus, parts), 0, LATER_RATE)


def score_ids(model: Model, ids: list[np.ndarray]) -> list[np.ndarray]:
    """log10 probability of each id of each sequence; windows of all sequences are scored together."""
    out: list[np.ndarray] = []
    held: list[tuple] = []

    def flush():
        x, y, scored = (np.concatenate(m) for m in zip(*held, strict=True))
        logs = np.concatenate([model.log10(x[i : i + SCORED_WINDOWS], y[i : i + SCORED_WINDOWS]) for i in range(0, len(x), SCORED_WINDOWS)])
        edge = 0
        for _, _, own in held:
            out.append(logs[edge : edge + len(own)][own])
            edge += len(own)
        held.clear()

    for i, own in enumerate(ids):
        held.append(windows(own))
        if sum(len(h[0]) for h in held) > 16 * SCORED_WINDOWS or i == len(ids) - 1:
            flush()
    return out


def text_score(words: np.ndarray, unigram: np.ndarray) -> float:
    """log10 probability of words: each is half its subwords (``words``) and half its unigram."""
    top = np.maximum(words, unigram)
    return float((top + np.log10(0.5 * (10.0 ** (words - top) + 10.0 ** (unigram - top)))).sum())


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` and its count ``c`` over all of ``docs``; the empty word counts the ends."""

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                held.update(split(text))
            held[b""] += len(batch["text"])
            if len(held) >= HELD_WORDS:
                yield {"word": list(held), "c": list(held.values())}
                held = Counter()
        if held:
            yield {"word": list(held), "c": list(held.values())}

    return map_batches(texts(docs), count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def id_counts(vocabulary: DataFrame, path: str) -> np.ndarray:
    """Counts of each subword id over the training corpus, from its word counts."""

    def count(batches):
        ids = WordIds(path)
        total = np.zeros(VOCABULARY + 1, dtype=np.int64)
        for batch in batches:
            for word, c in zip(batch["word"], batch["c"], strict=True):
                if word:
                    np.add.at(total, np.frombuffer(ids[word], dtype=np.uint16), c)
                else:
                    total[END] += c
        seen = np.nonzero(total)[0]
        if len(seen):
            yield {"id": seen, "c": total[seen]}

    rows = map_batches(vocabulary, count, "id int, c long").groupBy("id").agg(F.sum("c").alias("c")).collect()  # one row an id
    out = np.zeros(VOCABULARY + 1, dtype=np.int64)
    for row in rows:
        out[row["id"]] = row["c"]
    return out


def score(docs: DataFrame, training: DataFrame, path: str | None = None, steps: int = STEPS) -> DataFrame:
    """One row per document: ``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Null and empty texts are one token, the end. Repeated rows have a row each. Without a training
    document every base probability is 1 and the model is untrained. Other columns are left behind.
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    vocabulary = stored(word_counts(training), "vocabulary")
    state = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, whole = state["n"], state["n"] + state["v"] + 1
    # steps of an eighth of a doubling; the largest words go to all tasks, whole steps of at most FREQUENT_WORDS
    step = F.floor(F.log2("c") * 8)
    room, lowest = FREQUENT_WORDS, 1 << 20
    for row in sorted(vocabulary.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):  # some hundred rows
        room -= row["count"]
        if room < 0:
            break
        lowest = row["step"]
    top = vocabulary.where(step >= lowest).toPandas()  # at most FREQUENT_WORDS rows
    frequent = {bytes(word): c for word, c in zip(top["word"], top["c"].tolist(), strict=True)}
    n_docs = vocabulary.where(F.length("word") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]

    model = fit_corpus(training, id_counts(vocabulary, path), path, steps)
    sent = spark.sparkContext.broadcast((model, {word: math.log10((c + 1) / whole) for word, c in frequent.items()}))
    end_log = math.log10((n_docs + 1) / whole)

    def run(batches):
        model_, logs = sent.value
        ids = WordIds(path)
        nth = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: dict = {k: [] for k in ("row", "doc_id", "n_tokens", "known", "base", "rare", "owns", "score")}
            split_ = [split(text) for text in batch["text"]]
            found = [ids.of(words) for words in split_]
            scored = score_ids(model_, [f[0] for f in found])
            for doc_id, words, (_, starts), own in zip(batch["doc_id"], split_, found, scored, strict=True):
                unigram = np.fromiter((logs.get(w, -math.inf) for w in words), dtype=np.float64, count=len(words))
                known = unigram > -math.inf
                halves = np.add.reduceat(own.astype(np.float64), starts)
                rare: dict = {}
                for at in np.nonzero(~known)[0].tolist():
                    rare.setdefault(words[at], []).append(float(halves[at]))
                here = np.append(known, True)
                out["row"].append(nth)
                out["doc_id"].append(doc_id)
                out["n_tokens"].append(len(words) + 1)
                out["known"].append(int(known.sum()) + (n_docs > 0))
                out["base"].append(math.fsum(unigram[known]) + end_log)
                out["rare"].append(list(rare))
                out["owns"].append(list(rare.values()))
                out["score"].append(text_score(halves[here], np.append(unigram, end_log)[here]))
                nth += 1
            yield out

    schema = "row long, doc_id long, n_tokens long, known long, base double, rare array<binary>, owns array<array<double>>, score double"
    every = stored(map_batches(texts(docs), run, schema), "scored")
    rare = every.select("row", F.explode(F.arrays_zip("rare", "owns")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.owns").alias("owns"))
    met = rare.join(vocabulary.where(step < lowest), "word", "left").withColumn("times", F.size("owns"))
    log = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(whole)))
    # a word outside the training corpus has no unigram half
    mixed = lambda x: F.greatest(x, log) + F.log10((F.pow(F.lit(10.0), x - F.greatest(x, log)) + F.pow(F.lit(10.0), log - F.greatest(x, log))) / 2)
    half = F.when(F.col("c").isNull(), F.aggregate("owns", F.lit(0.0), lambda at, x: at + x + math.log10(0.5))).otherwise(F.aggregate("owns", F.lit(0.0), lambda at, x: at + mixed(x)))
    sums = met.groupBy("row").agg(F.sum(F.col("times") * log).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("more_known"), F.sum(half).alias("more_score"))
    return every.join(sums, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


@query("op6_lm_scoring")
def op6(spark, sf_dir):
    """Scores of all documents; learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, docs.where(fold(7) != 2))
    return found.select("doc_id", (fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
