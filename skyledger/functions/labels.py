"""Outcome-label and rule-text parsing as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label grammar (after dash and space normalization).
NUMBER = r"(-?\d+(?:\.\d+)?)"
UNIT = r"\s*°?\s*([CF])?"
BELOW = rf"(?i)^\s*{NUMBER}{UNIT}\s*or\s*(?:below|lower|under)\s*$"
ABOVE = rf"(?i)^\s*{NUMBER}{UNIT}\s*or\s*(?:higher|above|over)\s*$"
AT_MOST = rf"(?i)^\s*(<=|≤|<)\s*{NUMBER}{UNIT}\s*$"
AT_LEAST = rf"(?i)^\s*(>=|≥|>)\s*{NUMBER}{UNIT}\s*$"
RANGE = rf"(?i)^\s*{NUMBER}\s*-\s*{NUMBER}{UNIT}\s*$"
EXACT = rf"(?i)^\s*{NUMBER}{UNIT}\s*$"
ANY_UNIT = r"(?i)([CF])\b"

BIN_TYPE = (
    "struct<label:string,lower:double,upper:double,lower_inclusive:boolean,upper_inclusive:boolean>"
)


def normalize_label(label: Column) -> Column:
    """One kind of dash, single spaces, no outer space."""
    dashes = F.translate(label, "–—−", "---")
    return F.trim(F.regexp_replace(dashes, r"\s+", " "))


def label_unit(label: Column) -> Column:
    """Unit named in a label, null where it names none."""
    found = F.upper(F.regexp_extract(normalize_label(label), ANY_UNIT, 1))
    return F.when(found != "", found)


def parse_label(label: Column, default_unit: Column) -> Column:
    """Struct of an outcome bin, its unit and an error text for unsupported labels."""
    text = normalize_label(label)

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group)

    def number(pattern: str, group: int) -> Column:
        return part(pattern, group).try_cast("double")

    def rule(pattern: str, unit_group: int, lower, upper, lower_in=None, upper_in=None):
        unit = F.coalesce(F.when(part(pattern, unit_group) != "", F.upper(part(pattern, unit_group))), default_unit)
        null = F.lit(None).cast("double")
        body = F.struct(
            F.trim(label).alias("label"),
            (null if lower is None else lower).alias("lower"),
            (null if upper is None else upper).alias("upper"),
            (F.lit(True) if lower_in is None else lower_in).alias("lower_inclusive"),
            (F.lit(True) if upper_in is None else upper_in).alias("upper_inclusive"),
            unit.alias("unit"),
            F.when(unit.isNull(), F.concat(F.lit("Unsupported outcome label: "), label)).alias("error"),
        )
        return text.rlike(pattern), body

    rules = [
        rule(BELOW, 2, None, number(BELOW, 1)),
        rule(ABOVE, 2, number(ABOVE, 1), None),
        rule(AT_MOST, 3, None, number(AT_MOST, 2), upper_in=part(AT_MOST, 1).isin("<=", "≤")),
        rule(AT_LEAST, 3, number(AT_LEAST, 2), None, lower_in=part(AT_LEAST, 1).isin(">=", "≥")),
        rule(RANGE, 3, number(RANGE, 1), number(RANGE, 2)),
        rule(EXACT, 2, number(EXACT, 1), number(EXACT, 1)),
    ]
    null = F.lit(None)
    failed = F.struct(
        F.trim(label).alias("label"),
        null.cast("double").alias("lower"),
        null.cast("double").alias("upper"),
        F.lit(True).alias("lower_inclusive"),
        F.lit(True).alias("upper_inclusive"),
        null.cast("string").alias("unit"),
        F.concat(F.lit("Unsupported outcome label: "), label).alias("error"),
    )
    out = failed
    for condition, body in reversed(rules):
        out = F.when(condition, body).otherwise(out)
    return out


def parse_label_table(df: DataFrame, market: Sequence[str], label: str) -> DataFrame:
    """Parse a table of labels; the default unit is the one all labels of the
    market share, else Celsius. Units reduce to a minimum and maximum per market."""
    unit = label_unit(F.col(label))
    units = df.groupBy(*market).agg(F.min(unit).alias("__lo"), F.max(unit).alias("__hi"))
    shared = units.select(
        *[F.col(m).alias(f"__m_{m}") for m in market],
        F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).otherwise("C").alias("__unit"),
    )
    on = [df[m].eqNullSafe(shared[f"__m_{m}"]) for m in market]
    parsed = df.join(shared, on).withColumn("__bin", parse_label(F.col(label), F.col("__unit")))
    return parsed.select(
        *df.columns, *[F.col(f"__bin.{c}") for c in ("lower", "upper", "lower_inclusive", "upper_inclusive", "unit", "error")]
    )


# Question, date, station and policy phrases of the rule texts.
QUESTION = r"(?i)highest temperature in (.+?) on ([A-Za-z0-9 ,'-]+)\?"
RULE_DATE = r"(?i)on\s+(\d{1,2}\s+[A-Za-z]{3}\s+'?\d{2,4})"
STATION = r"(?i)recorded (?:at|by NOAA at) the (.+?)(?: Station|\s+in degrees)"
SOURCE_URL = r"(https?://\S+)"
FINALIZED = r"(?i)can not resolve to \"yes\" until all data .* finalized"
REVISION = r"(?i)revisions .* after data is finalized .* will not be considered"
WHOLE_DEGREE = r"(?i)(measures temperatures to whole degrees\s*(?:Celsius|Fahrenheit))"
SITE_CODE = r"(?i)[?&]site=([A-Z0-9]{4,6})"
LETTER_STATION = r"(?i)station\s+([A-Z]{2,4})"
DIGIT_STATION = r"(?i)station\s+(\d{5,6})"
# Source families by the phrases that name them, first match wins.
SOURCE_PHRASES = [
    ("Wunderground", ["wunderground"]),
    ("NOAA Timeseries", ["information from noaa", "weather.gov/wrh/timeseries"]),
    ("Hong Kong Observatory Daily Extract", ["hong kong observatory"]),
    ("Central Weather Administration", ["central weather administration", "cwa"]),
]
DATE_FORMATS = ["d MMM yyyy", "MMMM d, yyyy", "MMMM d yyyy", "d MMMM yyyy", "MMM d yyyy", "yyyy-MM-dd"]


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """Regex group, null where the pattern does not match."""
    value = F.regexp_extract(text, pattern, group)
    return F.when(value != "", value)


def source_family(name: Column) -> Column:
    """Official source named by a free text; null when none is known."""
    lowered = F.lower(name)
    out = F.lit(None).cast("string")
    for family, phrases in reversed(SOURCE_PHRASES):
        hit = F.lit(False)
        for phrase in phrases:
            hit = hit | F.contains(lowered, F.lit(phrase))
        out = F.when(hit, family).otherwise(out)
    return out


# Dates inside free text, month first or day first.
MONTH_FIRST = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})"
DAY_FIRST = r"(?i)\b(\d{1,2})(?:st|nd|rd|th)?\s+(?:of\s+)?(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?,?\s+(\d{4})"


def parse_date_text(text: Column) -> Column:
    """Date from the known formats, else from a date inside the text, else null."""
    tidy = F.regexp_replace(F.trim(text), r"\s+", " ")

    def inside(pattern: str, day: int, month: int) -> Column:
        part = lambda i: F.regexp_extract(tidy, pattern, i)
        return F.concat_ws(" ", part(day), F.initcap(part(month)), part(3))

    exact = [F.try_to_timestamp(tidy, F.lit(f)) for f in DATE_FORMATS]
    loose = [F.try_to_timestamp(inside(MONTH_FIRST, 2, 1), F.lit("d MMM yyyy")), F.try_to_timestamp(inside(DAY_FIRST, 1, 2), F.lit("d MMM yyyy"))]
    return F.to_date(F.coalesce(*exact, *loose))


def parse_rules(text: Column, question: Column | None = None) -> Column:
    """Struct of the facts in one market's rule text; the market's own question goes before the text's."""
    line = F.trim(found(text, r"(?im)^(.*highest temperature in.*)$"))
    question = line if question is None else F.coalesce(question, line)
    asked = found(question, QUESTION, 2)
    ruled = found(text, RULE_DATE, 1)
    date = parse_date_text(F.regexp_replace(F.coalesce(ruled, asked), "'", "20"))
    source = source_family(text)
    url = F.regexp_replace(found(text, SOURCE_URL), r"[).]+$", "")
    url_code = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    station = (
        F.when(source == "Wunderground", url_code)
        .when(source == "NOAA Timeseries", F.upper(found(url, SITE_CODE)))
        .when(source.startswith("Hong Kong"), F.coalesce(found(url, r"station=([A-Z0-9]+)"), F.upper(found(text, LETTER_STATION))))
        .when(source.startswith("Central"), found(text, DIGIT_STATION))
    )
    return F.struct(
        question.alias("question"),
        F.trim(found(question, QUESTION, 1)).alias("city"),
        date.alias("target_date"),
        source.alias("source_name"),
        url.alias("source_url"),
        F.trim(found(text, STATION)).alias("station_name"),
        station.alias("station_id"),
        F.coalesce(found(text, WHOLE_DEGREE), F.lit("exact_source")).alias("precision_text"),
        text.rlike(FINALIZED).alias("wait_for_finalized"),
        text.rlike(REVISION).alias("ignore_late_revision"),
        F.when(source == "Wunderground", "research_public").otherwise("exact_public").alias("truth_track"),
        (F.coalesce(source, F.lit("")) != "Wunderground").alias("settlement_eligible"),
    )


# Phrases of a description that name a supported resolution source.
SOURCE_HINTS = ("wunderground", "hong kong observatory", "central weather administration", "highest temperature recorded")


def is_temperature_market(question: Column, description: Column, outcomes: Column) -> Column:
    """Daily-high market: question wording, a known source, a degree label."""
    asked = F.trim(question).rlike(r"(?i)highest temperature in .+ on .+\?")
    text = F.lower(description)
    hinted = F.lit(False)
    for hint in SOURCE_HINTS:
        hinted = hinted | F.contains(text, F.lit(hint))
    degrees = F.exists(outcomes, lambda o: F.contains(F.lower(o), F.lit("°c")) | F.contains(F.lower(o), F.lit("°f")))
    return F.coalesce(asked & hinted & degrees, F.lit(False))


def safe_token(value: Column) -> Column:
    """Lower-case ASCII word characters joined by single underscores."""
    token = F.trim(F.regexp_replace(F.lower(F.trim(value)), r"[^0-9a-zA-Z]+", "_"), F.lit("_"))
    return F.when(token != "", token).otherwise("unknown")


def safe_slug(value: Column) -> Column:
    """Letters and digits kept in lower case, every other character an underscore."""
    slug = F.trim(F.lower(F.regexp_replace(F.trim(value), r"[^\p{L}\p{N}]", "_")), F.lit("_"))
    return F.when(slug != "", slug).otherwise("item")


def _ladder(text: Column, steps: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    out = F.lit(default)
    for name, phrases in reversed(steps):
        hit = F.lit(False)
        for phrase in phrases:
            hit = hit | F.contains(text, F.lit(phrase))
        out = F.when(hit, name).otherwise(out)
    return out


# Adapter keys by the phrases of the official source name.
ADAPTERS = [
    ("wunderground", ["wunderground"]),
    ("hko", ["hong kong observatory"]),
    ("cwa", ["central weather administration", "cwa"]),
    ("noaa", ["noaa"]),
]
# Public sources of research markets by the phrases of their name.
PUBLIC_SOURCES = [
    ("amo_air_calp", ["air_calp"]),
    ("wunderground", ["wunderground"]),
    ("noaa_daily_summaries", ["daily summaries"]),
]


def adapter_key(official_name: Column) -> Column:
    return _ladder(F.lower(official_name), ADAPTERS, "unknown")


def truth_source_key(official_name: Column, public_name: Column, truth_track: Column) -> Column:
    """Truth adapter of a market; research markets may name a public source."""
    own = adapter_key(official_name)
    public = _ladder(F.lower(F.coalesce(public_name, F.lit(""))), PUBLIC_SOURCES, "")
    research = F.coalesce(truth_track == "research_public", F.lit(False))
    return (
        F.when(research & (public != ""), public)
        .when(research & (own == "wunderground"), "noaa_global_hourly")
        .when(own == "noaa", "noaa_global_hourly")
        .otherwise(own)
    )


# Fixed value: message of a request for a place the archive does not cover.
NO_DATA_MESSAGE = "no data is available for this location"


def availability_status(http_status: Column, reason: Column) -> Column:
    """Whether a failed forecast request is unavailable for good or an error."""
    no_data = F.contains(F.lower(F.coalesce(reason, F.lit(""))), F.lit(NO_DATA_MESSAGE))
    gone = http_status.isin(404, 422) | ((http_status == 400) & no_data)
    return F.when(gone, "unavailable").otherwise("error")


def lookup(value: Column, table: Mapping[str, int], default: int) -> Column:
    """Literal map lookup with a default (source priorities and the like)."""
    entries = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*entries), value), F.lit(default))


def signature(*fields: Column) -> Column:
    """Stable SHA-256 of named fields, in the order given by their names."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def group_id(*parts: Column) -> Column:
    return F.concat_ws("|", *[p.cast("string") for p in parts])


def market_unit(spec_json: Column) -> Column:
    return F.coalesce(F.get_json_object(spec_json, "$.unit"), F.lit("C"))


def market_city(city: Column, spec_json: Column) -> Column:
    return F.coalesce(city, F.get_json_object(spec_json, "$.city"), F.lit("unknown"))


def market_volume(top_level: Column, components: Column) -> Column:
    """Own volume, else the sum over component markets; null when neither is there."""
    total = F.aggregate(components, F.lit(0.0), lambda acc, v: acc + F.coalesce(v.cast("double"), F.lit(0.0)))
    return F.coalesce(top_level.cast("double"), F.when(F.size(components) > 0, total))


# Collection statuses that a later run revisits, the details that
# older logs stored as parse failures, and messages of a lagging truth archive.
OPEN_STATUSES = ("not_closed", "not_historical", "truth_source_lag", "truth_parse_failed", "truth_request_failed")
OPEN_DETAILS = ("not_closed", "not_historical")
LAG_MESSAGES = (
    "no hko record",
    "no cwa codis daily row",
    "no wunderground historical observations found",
    "no wunderground historical temperature values found",
    "could not parse wunderground daily max",
    "no noaa global hourly rows",
    "could not parse cwa daily max",
    "missing airtemperature.maximum",
    "no record for ",
)
RULE_MESSAGES = ("unsupported official source", "unsupported question format")


def mentions(text: Column, phrases: Sequence[str]) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | F.contains(lowered, F.lit(phrase))
    return hit


def retryable(status: Column, detail: Column) -> Column:
    """Whether a collection entry is revisited on the next run."""
    legacy = (status == "parse_failed") & detail.isin(*OPEN_DETAILS)
    return F.coalesce(status.isin(*OPEN_STATUSES) | legacy, F.lit(False))


def source_lag(message: Column) -> Column:
    return mentions(message, LAG_MESSAGES)


def unsupported_rule(message: Column) -> Column:
    return mentions(message, RULE_MESSAGES)
