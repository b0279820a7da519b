"""Language ID by rank-order profiles of character n-grams.

A profile is the list of the most frequent 1- to 3-grams, most frequent first. A document belongs to
the language whose profile is least out of place: the sum over the document's own list of how far each
n-gram's rank is from its rank in the profile, with the list length for one that the profile lacks.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.base import fold, map_batches, query, table, texts

#: Length of a profile.
PROFILE = 300
#: About so many labelled documents of each language are learned from.
SAMPLE_PER_LANGUAGE = 600
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (code points packed by 21 bits, words padded by a space) and their counts."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    points = np.where(letters()[points], points, 32).astype(np.int64)
    points = np.concatenate(([32], points, [32]))
    points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
    inner = points[1:-1] != 32
    grams = np.concatenate((points[points != 32], (points[:-1] << 21) | points[1:], ((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])[inner]))
    if not len(grams):
        return grams, grams
    grams.sort()
    starts = np.concatenate(([0], np.nonzero(grams[1:] != grams[:-1])[0] + 1))
    return grams[starts], np.diff(np.concatenate((starts, [len(grams)])))


def ranked(text: str, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams of a text, most frequent first, ties by code; none without a letter."""
    grams, counts = gram_counts(text)
    return grams[np.argsort(-counts, kind="stable")[:size]]


def learn(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles from ``text`` and non-null ``lang`` of labelled documents.

    Fitted on about ``per_language`` documents of each label, chosen by the hash of their id; all
    documents of a label that has fewer. Whole texts are counted. Every label is a language.
    """
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    steps = 1 << 30
    sizes = labelled.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count("*")).alias("share"))
    # a row a label, where every task gets a profile a label: texts need not be shuffled to be sampled
    wanted = labelled.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(steps)) < F.floor(F.col("share") * steps))

    def count(batches):
        total = defaultdict(int)
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                for gram, n in zip(*(a.tolist() for a in gram_counts(text)), strict=True):
                    total[lang, gram] += n
        if total:
            yield {"lang": [k[0] for k in total], "gram": [k[1] for k in total], "n": list(total.values())}

    grams = map_batches(wanted.select("lang", "text"), count, "lang string, gram long, n long")
    sums = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    out: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "rank").collect():  # at most ``size`` rows of each language
        out.setdefault(row["lang"], []).append(row["gram"])
    return out


class Profiles:
    """Learned profiles by n-gram: the languages that have it and its rank in each."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted(profiles)
        lengths = [len(profiles[lang]) for lang in self.langs]
        grams = np.array([g for lang in self.langs for g in profiles[lang]], dtype=np.int64)
        order = np.argsort(grams, kind="stable")
        self.lang = np.repeat(np.arange(len(self.langs)), lengths)[order]
        self.rank = np.concatenate([np.zeros(0, dtype=np.int64), *map(np.arange, lengths)])[order]
        self.grams, first = np.unique(grams[order], return_index=True)
        self.first = np.append(first, len(grams))

    def predict(self, text: str) -> tuple[str, float]:
        """The language least out of place and 1 minus its distance as a share of the largest."""
        own = ranked(text, self.size)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = np.nonzero(self.grams[at] == own)[0]
        first, n = self.first[at[known]], self.first[at[known] + 1] - self.first[at[known]]
        entries = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        # an n-gram that a profile has is that much nearer than one it lacks
        nearer = self.size - np.abs(self.rank[entries] - np.repeat(known, n))
        distance = self.size * len(own) - np.bincount(self.lang[entries], weights=nearer, minlength=len(self.langs)).astype(np.int64)
        best = int(np.argmin(distance))
        return self.langs[best], float(1 - distance[best] / (self.size * len(own)))


def identify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """One row per document: ``doc_id``, ``lang_pred``, ``score``.

    A null or empty text, or one without a letter, gives ``und`` with score 0, as does every text
    where nothing was learned. Repeated rows are judged alike; ties go to the first label in order.
    Only ``text`` is an input.
    """

    def run(batches):
        known = Profiles(profiles)
        for batch in batches:
            found = [known.predict(text) for text in batch["text"]]
            yield {"doc_id": batch["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    return map_batches(texts(docs), run, "doc_id long, lang_pred string, score double")


def training(docs: DataFrame) -> DataFrame:
    """The documents that may be learned from."""
    return docs.select("doc_id", "text", "lang").where(fold(4) != 2)


def keep_identified(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents of no language (``und``) go, all others stay as they are."""
    known = learn(training(docs))

    def run(batches):
        profiles = Profiles(known)
        for batch in batches:
            keep = [text is not None and profiles.predict(text)[0] != UNKNOWN for text in batch["text"]]
            yield {name: [v for v, k in zip(values, keep, strict=True) if k] for name, values in batch.items()}

    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return map_batches(own, run, "doc_id long, text string, lang string, source string, n_chars long")


@query("op2_language_id")
def op2(spark, sf_dir):
    """The language of every whole document; learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(training(docs)))
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")
