"""Secret scans: character Markov models of random strings and of ordinary identifiers.

Fixed patterns find the base secrets. Beside them every long unbroken token is judged by the log
likelihood ratio of two first-order Markov chains over characters alone, one trained on random strings
(values of base secrets and seeded ones), one on ordinary words of the corpus and identifiers made of
them. The least ratio depends on the length: all but a fixed share of held-out random strings exceed it.
"""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.base import hash_sample, map_batches, query, table, texts

# Fixed patterns of the contract.
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "model")
#: Runs that hold every access, hex and model span: their characters are among these.
LONG_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
INDEX = {c: i for i, c in enumerate(ALPHABET)}
#: About so many documents are trained on, and at most so many strings of either kind.
SAMPLE_DOCS = 4000
SAMPLE_STRINGS = 20000
#: Seeded random strings, so that the random model knows alphabets that the sample lacks.
SEEDED = 3000
#: Identifiers made of ordinary words, and rulers of one character, so that the ordinary model knows joints.
SEEDED_NAMES, SEEDED_RULERS = 12000, 40
#: Characters that a token needs, and the share of random strings of a length that may be missed.
LEAST_LENGTH, MISSED = 20, 0.004
#: Lengths whose least ratio is measured, on so many held-out strings of each kind; others lie between.
LENGTHS, HELD_OUT = (20, 22, 24, 28, 32, 40, 48, 64, 96), 2000
#: Alphabets of random strings.
KINDS_OF_RANDOM = (string.hexdigits[:16], string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The contract's spans (start, end, kind), code points, leftmost and non-overlapping by kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
    for run in LONG_RUN.finditer(text):
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text, run.start(), run.end()) if m.end() - m.start() >= ACCESS_LEAST]
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text, run.start(), run.end()) if m.end() - m.start() >= HEX_LEAST]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def chain(strings: list[str]) -> np.ndarray:
    """Log probabilities of each next character after each (row 0: at the start), add-one smoothed."""
    counts = np.ones((len(ALPHABET) + 1, len(ALPHABET)))
    for text in strings:
        at = [INDEX[c] for c in text]
        np.add.at(counts, ([0, *[i + 1 for i in at[:-1]]], at), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def seeded(n: int = SEEDED) -> list[str]:
    """Labelled random strings: hexadecimal, base 62 and base 64, from a fixed seed."""
    rng = random.Random(1)
    return ["".join(rng.choices(KINDS_OF_RANDOM[i % len(KINDS_OF_RANDOM)], k=32)) for i in range(n)]


def seeded_names(words: list[str], n: int = SEEDED_NAMES) -> list[str]:
    """Labelled identifiers: snake, kebab, path, camel and constant names of ordinary words, some with a number, and rulers."""
    rng = random.Random(2)
    plain = [w for w in words if w.isalpha()] or ["name"]
    out = []
    for i in range(n):
        own = [w[:9].lower() for w in rng.choices(plain, k=rng.randint(2, 5))]
        style = i % 5
        name = "".join(w.capitalize() for w in own) if style == 3 else "_-/_"[style % 4].join(own)
        name = name.upper() if style == 4 else name
        out.append(name + rng.choice(("", "", "_", "-", "/")) + rng.choice(("", "", f"{rng.randint(0, 99):02d}", f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}")))
    return out + [c * 40 for c in "-=_+/" for _ in range(SEEDED_RULERS)]


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """Log likelihood ratio of each transition, random strings over ordinary identifiers.

    Fitted on about ``sample_docs`` documents chosen by the hash of their id, whole texts. Base
    secrets label the random strings, words of eight and more characters outside them the others.
    """
    n = docs.count()
    sample = hash_sample(texts(docs), "doc_id", sample_docs / max(n, 1))

    def label(batches):
        word = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
        for batch in batches:
            strings, random_ = [], []
            for text in batch["text"]:
                spans = base_spans(text)
                for start, end, kind in spans:
                    value = ASSIGN.match(text, start, end)[1] if kind == "assign" else text[start:end]
                    strings.append(value.replace(".", ""))
                    random_.append(True)
                edge, rest = 0, []
                for start, end, _ in spans:
                    rest.append(text[edge : max(edge, start)])
                    edge = max(edge, end)
                found = set(word.findall(" ".join([*rest, text[edge:]])))
                strings += found
                random_ += [False] * len(found)
            yield {"string": strings, "random": random_}

    labelled = map_batches(sample, label, "string string, random boolean").distinct()
    chosen = []
    for kind in (True, False):  # bounded: SAMPLE_STRINGS of each, the first by hash
        own = labelled.where(F.col("random") == kind).orderBy(F.xxhash64("string"), "string").limit(SAMPLE_STRINGS)
        chosen.append([r["string"] for r in own.collect()])
    return chain(chosen[0] + seeded()) - chain(chosen[1] + seeded_names(chosen[1]))


def least_ratios(ratio: np.ndarray) -> np.ndarray:
    """For each of ``LENGTHS`` the ratio that all but a share of ``MISSED`` of held-out strings of every kind exceed."""
    rng = np.random.default_rng(3)
    out = []
    for length in LENGTHS:
        means = []
        for kind in KINDS_OF_RANDOM:
            at = np.array([INDEX[c] for c in kind])[rng.integers(0, len(kind), (HELD_OUT, length))]
            before = np.concatenate((np.zeros((HELD_OUT, 1), dtype=np.int64), at[:, :-1] + 1), axis=1)
            means.append(np.quantile(ratio[before, at].mean(axis=1), MISSED))
        out.append(min(means))
    return np.array(out)


def scorer(ratio: np.ndarray):
    """How far the ratio per character of a token is above the least one of its length."""
    rows = {c: dict(zip(ALPHABET, ratio[i], strict=True)) for c, i in [("", 0), *[(c, i + 1) for c, i in INDEX.items()]]}
    least = least_ratios(ratio)

    def score(token: str) -> float:
        return sum(rows[a][b] for a, b in zip(["", *token], token, strict=False)) / len(token) - float(np.interp(len(token), LENGTHS, least))

    return score


def model_spans(text: str, spans: list[tuple[int, int, str]], score) -> list[tuple[int, int, str]]:
    """Long tokens apart from all base spans that look random."""
    out = []
    for run in LONG_RUN.finditer(text):
        token = run[0]
        if len(token) < LEAST_LENGTH:
            continue
        if any(start < run.end() and run.start() < end for start, end, _ in spans):
            continue
        if score(token) >= 0:
            out.append((run.start(), run.end(), "model"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def scan(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """One row per document: base counts, the digest of the base spans and all spans.

    Null and empty texts have no spans (the digest of the empty string). Repeated rows are scanned
    alike; an empty table gives an empty one; other columns of ``docs`` are left behind.
    """

    def run(batches):
        score = scorer(ratio)
        for batch in batches:
            out = {"doc_id": batch["doc_id"], "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
            for text in batch["text"]:
                base = base_spans(text)
                kinds = [kind for _, _, kind in base]
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(kinds.count(kind))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(base + model_spans(text, base, score)))
            yield out

    return map_batches(texts(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, str]], mask: str) -> str:
    """The text with every stretch of touching or overlapping spans replaced by ``mask``."""
    out, edge = [], 0
    for start, end, _ in sorted(spans):
        if start >= edge:
            out += [text[edge:start], mask]
        edge = max(edge, end)
    return "".join([*out, text[edge:]])


def redact(spark, docs: DataFrame, sf_dir: str, mask: str = "[SECRET]") -> DataFrame:
    """Pipeline stage: all documents stay; each found span gives way to ``mask``, ``n_chars`` follows.

    Texts without a span, null ones included, stay as they are.
    """
    ratio = train(docs)

    def run(batches):
        score = scorer(ratio)
        for batch in batches:
            for i, text in enumerate(batch["text"]):
                if text and (spans := [*(base := base_spans(text)), *model_spans(text, base, score)]):
                    batch["text"][i] = masked(text, spans, mask)
                    batch["n_chars"][i] = len(batch["text"][i])
            yield batch

    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return map_batches(own, run, "doc_id long, text string, lang string, source string, n_chars long")


@query("op1_secret_scan")
def op1(spark, sf_dir):
    """Secrets of every whole document."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
