"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every measure is a column expression over the row itself, so the scan is the only stage: nothing is
shuffled and no row depends on another.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.base import once, query, table

# Frequent function words of the languages at hand.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "as", "be", "at", "by", "this", "are", "from", "or", "an", "not"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au", "sur", "ne", "se"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo", "como"),
}


@dataclass(frozen=True)
class Rule:
    """Fails a text where ``scale * part`` is beyond ``limit * whole`` (both whole numbers)."""

    name: str
    part: str
    whole: str
    limit: int
    above: bool = True
    scale: int = 100

    def sql(self) -> str:
        return f"{self.scale} * {self.part} {'>' if self.above else '<'} {self.limit} * {self.whole}"


#: Base rules of the contract, then the verdict's own. A ratio over nothing never fails.
BASE_RULES = (
    Rule("few_words", "n_words", "1", 50, above=False, scale=1),
    Rule("repeated_words", "n_repeat_words", "n_words", 50),
)
RULES = (
    Rule("short_words", "word_chars", "n_words", 200, above=False),
    Rule("long_words", "word_chars", "n_words", 2000),
    Rule("symbols", "n_symbols", "word_chars", 5),
    Rule("few_stop_words", "n_stop_words", "n_words", 2, above=False),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 40),
)


def stop_words() -> list[str]:
    return sorted({w for words in STOP_WORDS.values() for w in words})


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with the measured columns appended.

    Words are runs of non-space characters; a null text has none. Repeated three-word windows are
    found by sorting the hashes of the row's own windows, so one very long text costs n log n.
    """
    text = F.coalesce("text", F.lit(""))
    pieces = F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " ")  # a cut at every space character
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    stops = stop_words()
    out = docs.withColumns({"_text": text, "_pieces": pieces, "_lines": lines}).withColumn("_words", F.array_remove("_pieces", "")).withColumn("n_words", F.size("_words").cast("long"))
    windows = F.when(
        F.col("n_words") >= 3,
        F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("_windows", windows)
    pairs = F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    out = out.withColumn("_pairs", pairs)
    twice = F.filter("_pairs", lambda x, i: (F.get("_pairs", i - 1)["h"].eqNullSafe(x["h"]) & (i > 0)) | F.get("_pairs", i + 1)["h"].eqNullSafe(x["h"]))
    out = out.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("_at", start, lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    return out.withColumns(
        {
            "word_chars": (F.length("_text") - F.size("_pieces") + 1).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": once(covered.cast("long")),
            "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(stops))).cast("long"),
        }
    ).drop("_text", "_pieces", "_words", "_lines", "_windows", "_pairs", "_at")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: measures, ``base_failed``, ``kept`` and the names of the failed rules.

    Null and empty texts have no words and fail the base. Repeated rows are judged alike; other
    columns of ``docs`` are not looked at, whatever their names.
    """
    measured = measures(docs.select("doc_id", "text"))
    failed = {r.name: F.expr(r.sql()) for r in (*base, *rules)}
    base_failed = F.lit(False)
    for r in base:
        base_failed = base_failed | failed[r.name]
    any_failed = base_failed
    for r in rules:
        any_failed = any_failed | failed[r.name]
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in failed.items()]))
    return measured.select("doc_id", *MEASURES, base_failed.alias("base_failed"), (~any_failed).alias("kept"), "n_lines", "n_stop_words", F.array_join(names, ",").alias("failed_rules"))


def reference_sql() -> str:
    """The same table in DuckDB SQL."""
    stops = ", ".join(f"'{w}'" for w in stop_words())
    base = " OR ".join(r.sql() for r in BASE_RULES)
    every = " OR ".join(r.sql() for r in (*BASE_RULES, *RULES))
    names = ", ".join(f"CASE WHEN {r.sql()} THEN '{r.name}' END" for r in (*BASE_RULES, *RULES))
    return f"""
    WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
      list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
    p AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
    g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS n FROM p),
    r AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY rid),
    m AS (SELECT doc_id, len(words) AS n_words, coalesce(length(array_to_string(words, '')), 0) AS word_chars,
      length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
      len(list_filter(words, lambda x: lower(x) IN ({stops}))) AS n_stop_words FROM w LEFT JOIN r USING (rid))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed, NOT ({every}) AS kept,
      n_lines, n_stop_words, concat_ws(',', {names}) AS failed_rules FROM m"""


@query("op8_quality_rules", reference_sql())
def op8(spark, sf_dir):
    """Rules over every whole document."""
    return judge(table(spark, sf_dir, "documents"))
