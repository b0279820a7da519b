"""License scans by sentence rules.

Texts are cut into sentences, normalised (lower case, letters and digits only) and mapped to the
identifiers of known licence sentences. A licence is recognised where its rule, an ordered sequence of
identifiers, occurs in that order. Everything is a projection of column expressions: no row meets
another.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.base import once, query, table

# Sentences of public licences and of the usual notices, normalised, by identifier.
SENTENCES = {
    "apache2-ref": ("licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "spdx license identifier apache 2 0"),
    "apache2-use": ("you may not use this file except in compliance with the license",),
    "apache2-copy": ("you may obtain a copy of the license at",),
    "mit-ref": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "spdx license identifier mit"),
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    "mit-notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "isc-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "bsd-head": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd-names": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "gpl3-ref": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "spdx license identifier gpl 3 0 only", "spdx license identifier gpl 3 0 or later"),
    "gpl-free": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "gpl-warranty": ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "ccbync4-ref": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "ccby4-ref": ("licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "ccbysa4-ref": ("licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "cc0-ref": ("this work is dedicated to the public domain under cc0 1 0", "spdx license identifier cc0 1 0"),
}


@dataclass(frozen=True)
class Rule:
    """A licence whose sentences occur in order; ``unless`` names a licence that takes its place."""

    licence: str
    sequence: tuple[str, ...]
    unless: str | None = None


# Ordered rules.
RULES = (
    Rule("Apache-2.0", ("apache2-ref",)),
    Rule("Apache-2.0", ("apache2-use", "apache2-copy")),
    Rule("MIT", ("mit-ref",)),
    Rule("MIT", ("mit-grant", "mit-notice")),
    Rule("ISC", ("isc-grant",)),
    Rule("BSD-3-Clause", ("bsd-head", "bsd-source", "bsd-binary", "bsd-names")),
    Rule("BSD-2-Clause", ("bsd-head", "bsd-source", "bsd-binary"), unless="BSD-3-Clause"),
    Rule("GPL-3.0", ("gpl3-ref",)),
    Rule("GPL-3.0", ("gpl-free", "gpl-warranty")),
    Rule("CC-BY-NC-4.0", ("ccbync4-ref",)),
    Rule("CC-BY-4.0", ("ccby4-ref",)),
    Rule("CC-BY-SA-4.0", ("ccbysa4-ref",)),
    Rule("CC0-1.0", ("cc0-ref",)),
)
FREE = "this {} is free software you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation {} of the license{}"
LATER = " or at your option any later version"
WARRANTY = "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"


def notices(kind: str, version: str) -> tuple[str, ...]:
    """The sentences that put a work under a GNU licence, with and without later versions."""
    return tuple(FREE.format(work, kind, f"either version {version}" if later else f"version {version}", later) for work in ("program", "library", "software") for later in (LATER, ""))


def spdx(name: str) -> tuple[str, ...]:
    return tuple(f"spdx license identifier {name}{end}" for end in ("", " only", " or later"))


def under(name: str, *versions: str) -> tuple[str, ...]:
    return tuple(f"{verb} under the {name} {version}".strip() for verb in ("licensed", "released", "distributed") for version in (versions or ("",)))


# Sentences that the reference SQL, which has only those above, does not know.
MORE_SENTENCES = {
    "mit-ref": ("distributed under the mit license",),
    "apache2-ref": under("apache license", "version 2 0", "2 0", "v2 0"),
    "ccby4-ref": ("licensed under a creative commons attribution 4 0 international license",),
    "ccbync4-ref": ("licensed under a creative commons attribution noncommercial 4 0 international license",),
    "ccbysa4-ref": ("licensed under a creative commons attribution sharealike 4 0 international license",),
    "cc0-ref": ("dedicated to the public domain under cc0 1 0",),
    "gpl-free": notices("", "3"),
    "gpl2-free": (*notices("", "2"), "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"),
    "gpl-warranty": (WARRANTY, WARRANTY.replace("library", "software")),
    "gpl2-ref": (*under("gnu general public license", "version 2", "v2", "v2 0"), *spdx("gpl 2 0")),
    "gpl3-ref": (*under("gnu general public license", "version 3", "v3", "v3 0"), *spdx("gpl 3 0")),
    "lgpl21-free": notices("lesser ", "2 1"),
    "lgpl3-free": notices("lesser ", "3"),
    "lgpl21-ref": (*under("gnu lesser general public license", "version 2 1", "v2 1"), *spdx("lgpl 2 1")),
    "lgpl3-ref": (*under("gnu lesser general public license", "version 3", "v3", "v3 0"), *spdx("lgpl 3 0")),
    "agpl3-free": notices("affero ", "3"),
    "agpl3-ref": (*under("gnu affero general public license", "version 3", "v3", "v3 0"), *spdx("agpl 3 0")),
    "mpl2-head": ("this source code form is subject to the terms of the mozilla public license v",),  # the next full stop cuts "v. 2.0"
    "mpl2-copy": tuple(f"if a copy of the mpl was not distributed with this file you can obtain one at {h} mozilla org mpl 2 0" for h in ("http", "https")),
    "mpl2-ref": (*under("mozilla public license", "version 2 0", "2 0", "v2 0"), "spdx license identifier mpl 2 0"),
    "epl2-use": tuple(f"this program and the accompanying materials are made available under the terms of the eclipse public license {v} which is available at {h} www eclipse org legal epl 2 0" for v in ("2 0", "v2 0", "v 2 0") for h in ("http", "https")),
    "epl1-use": tuple(f"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at {h} www eclipse org legal epl v10 html" for h in ("http", "https")),
    "epl2-ref": (*under("eclipse public license", "version 2 0", "2 0", "v2 0"), "spdx license identifier epl 2 0"),
    "epl1-ref": (*under("eclipse public license", "version 1 0", "1 0", "v1 0"), "spdx license identifier epl 1 0"),
    "unlicense-free": ("this is free and unencumbered software released into the public domain",),
    "unlicense-ref": (*under("unlicense"), *under("unlicense license"), "spdx license identifier unlicense"),
}
MORE_RULES = (
    Rule("GPL-2.0", ("gpl2-ref",)),
    Rule("GPL-2.0", ("gpl2-free", "gpl-warranty")),
    Rule("LGPL-2.1", ("lgpl21-ref",)),
    Rule("LGPL-2.1", ("lgpl21-free", "gpl-warranty")),
    Rule("LGPL-3.0", ("lgpl3-ref",)),
    Rule("LGPL-3.0", ("lgpl3-free", "gpl-warranty")),
    Rule("AGPL-3.0", ("agpl3-ref",)),
    Rule("AGPL-3.0", ("agpl3-free", "gpl-warranty")),
    Rule("MPL-2.0", ("mpl2-ref",)),
    Rule("MPL-2.0", ("mpl2-head", "mpl2-copy")),
    Rule("EPL-1.0", ("epl1-ref",)),
    Rule("EPL-1.0", ("epl1-use",)),
    Rule("EPL-2.0", ("epl2-ref",)),
    Rule("EPL-2.0", ("epl2-use",)),
    Rule("Unlicense", ("unlicense-free",)),
    Rule("Unlicense", ("unlicense-ref",)),
)
#: A reference behind a subject ("our code is ..."), unless the subject denies it.
REFERENCE = r"^(?!.*\b(?:not|never|nor|no|neither|unless|if|unlike|previously|formerly)\b).* ((?:licensed|released|distributed) under .*|dedicated to .*)$"
#: Every known sentence has one of these words, so a text without them has none of the sentences.
ANCHORS = ("licen", "permission", "redistribution", "copyright", "warranty", "endorse", "cc0")
MORE_ANCHORS = (*ANCHORS, "unencumbered", r"if\s+a\s+copy")
#: Where sentences end: with line ends, and across lines (long sentences hold semicolons).
CUTS = (r"\n|(?<=[.!?;:])[\x20\x09-\x0D]+", r"(?<=[.!?:])[\x20\x09-\x0D]+")

#: The same without ':', which stands inside of sentences too ("free software: you can ..."); paragraphs end sentences.
MORE_CUTS = (r"\n|(?<=[.!?;])[\x20\x09-\x0D]+", r"\x01|(?<=[.!?])[\x20\x09-\x0D]+")
#: An empty line, of a comment too.
PARAGRAPH = r"\n(?:[\x20\x09-\x0D/*#;]*\n)+"


def identifiers(text: Column, cut: str) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    pairs = {s: name for names in (SENTENCES, MORE_SENTENCES) for name, sentences in names.items() for s in sentences}
    known = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    plain = F.transform(F.split(text, cut), lambda s: F.trim(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", " ")))
    of = lambda s: F.coalesce(F.try_element_at(known, s), F.when(s.contains(" under ") | s.contains(" dedicated to "), F.try_element_at(known, F.regexp_extract(s, REFERENCE, 1))))
    return F.filter(F.transform(plain, of), lambda x: x.isNotNull())


def follows(found: Column, sequence: tuple[str, ...]) -> Column:
    """Whether the identifiers of a rule occur in order: one pass that waits for the next of them."""
    steps = F.array(*[F.lit(s) for s in sequence])
    return F.aggregate(found, F.lit(0), lambda at, x: F.when(F.get(steps, at) == x, at + 1).otherwise(at)) == len(sequence)


def recognise(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``licences`` (sorted, comma-joined), ``sentences`` (identifiers
    in order, comma-joined) and ``n_sentences``.

    Sentences are cut at line ends too, and for wrapped texts once more across lines, both with and
    without a cut at ':'; any of the lists can meet a rule. Null, empty and unlicensed texts have empty lists. Repeated rows are judged alike.
    Other columns of ``docs`` are left behind.
    """
    text = F.coalesce("text", F.lit(""))
    empty = F.array().cast("array<string>")
    maybe = F.col("text").rlike("(?i)" + "|".join(MORE_ANCHORS))
    unwrapped = F.regexp_replace("text", r"[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*", " ")
    parted = F.regexp_replace(F.regexp_replace("text", PARAGRAPH, "\x01"), r"[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*", " ")
    ways = {"own": (F.col("text"), CUTS[0]), "wide": (unwrapped, CUTS[1]), "line": (F.col("text"), MORE_CUTS[0]), "paragraph": (parted, MORE_CUTS[1])}
    out = docs.select("doc_id", text.alias("text")).withColumns({name: once(F.when(maybe, identifiers(*way)).otherwise(empty)) for name, way in ways.items()})
    meets = {r: reduce(or_, [follows(F.col(name), r.sequence) for name in ways]) for r in (*RULES, *MORE_RULES)}
    named = []
    for rule, met in meets.items():
        for other in (r for r in RULES if r.licence == rule.unless):
            met = met & ~meets[other]
        named.append(F.when(met, F.lit(rule.licence)))
    most = F.greatest(*[F.size(name) for name in ways])
    any_known = most > 0
    licences = F.when(any_known, F.array_sort(F.array_distinct(F.array_compact(F.array(*named))))).otherwise(empty)
    sequence = F.coalesce(*[F.when(F.size(name) == most, F.col(name)) for name in ways])
    return out.select("doc_id", F.array_join(licences, ",").alias("licences"), F.array_join(sequence, ",").alias("sentences"), F.size(sequence).cast("long").alias("n_sentences"))


def reference_sql() -> str:
    """The same table in DuckDB SQL; rules become patterns over the joined identifiers."""
    known = "MAP {" + ", ".join(f"'{s}': '{name}'" for name, sentences in SENTENCES.items() for s in sentences) + "}"

    def ids(text: str, cut: str) -> str:
        # no lookbehind here: the cut keeps the mark by a placeholder
        marked = f"regexp_replace({text}, '([{cut}])[\\x20\\x09-\\x0D]+', '\\1' || chr(1), 'g')"
        plain = f"list_transform(string_split({marked}, chr(1)), lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')))"
        return f"list_filter(list_transform({plain}, lambda s: known[s]), lambda x: x IS NOT NULL)"

    def met(rule: Rule) -> str:
        pattern = "," + "(?:.*,)?".join(f"{s}," for s in rule.sequence)
        return f"(regexp_matches(o, '{pattern}') OR regexp_matches(w, '{pattern}'))"

    parts = []
    for rule in RULES:
        unless = "".join(f" AND NOT {met(r)}" for r in RULES if r.licence == rule.unless)
        parts.append(f"CASE WHEN {met(rule)}{unless} THEN '{rule.licence}' END")
    lines = "replace(text, chr(10), chr(1))"
    unwrapped = "regexp_replace(text, '[\\x20\\x09-\\x0D]*\\n[\\x20\\x09-\\x0D]*', ' ', 'g')"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {known} AS known FROM documents),
    s AS (SELECT doc_id, {ids(lines, '.!?;:')} AS own, {ids(unwrapped, '.!?:')} AS wide FROM d),
    j AS (SELECT doc_id, own, wide, ',' || array_to_string(own, ',') || ',' AS o, ',' || array_to_string(wide, ',') || ',' AS w FROM s),
    l AS (SELECT doc_id, own, wide, list_sort(list_distinct(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL))) AS licences FROM j)
    SELECT doc_id, coalesce(array_to_string(licences, ','), '') AS licences, coalesce(array_to_string(CASE WHEN len(own) >= len(wide) THEN own ELSE wide END, ','), '') AS sentences,
      greatest(len(own), len(wide)) AS n_sentences FROM l"""


@query("op10_license_scan", reference_sql())
def op10(spark, sf_dir):
    """Licences of every whole document."""
    return recognise(table(spark, sf_dir, "documents"))
