"""Market specifications from rule texts and a station registry.

Text facts are column expressions; the registry joins twice, by the lower-case names a city goes by and by
station id. It is a table of its own, so no station is written into the code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.labels import (
    DIGIT_STATION,
    LETTER_STATION,
    SITE_CODE,
    found,
    label_unit,
    parse_label,
    parse_rules,
)

# Character references that rule pages use.
REFERENCES = [("&nbsp;", " "), ("&deg;", "°"), ("&#176;", "°"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]
STATION = "struct<city:string,country:string,timezone:string,station_id:string,station_name:string,lat:double,lon:double,public_truth_source_name:string,public_truth_station_id:string>"


def plain_text(text: Column) -> Column:
    """The text of a page, one line per piece of text; other texts as they are, without outer space."""
    bare = F.regexp_replace(text, r"(?is)<!--.*?-->|<(script|style|template)\b.*?</\1\s*>", "\n")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", "\n")
    for name, character in REFERENCES:
        bare = F.replace(bare, F.lit(name), F.lit(character))
    lines = F.filter(F.transform(F.split(bare, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.when(text.rlike("(?i)<html|<body"), F.array_join(lines, "\n")).otherwise(F.regexp_replace(text, r"^\s+|\s+$", ""))


def registry(stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alias, station) and (station id, station) of a station table.

    Columns of ``stations``: ordinal, city, aliases and those of a station. A city's own station is its first. An alias is
    the city's name, a station's id or name, or one listed; the last to claim it wins, but a city keeps its own name.
    """
    fields = [f.split(":")[0] for f in STATION[7:-1].split(",")]
    rows = stations.select("ordinal", "city", "aliases", F.struct(*[F.col(f) for f in fields]).cast(STATION).alias("station"))
    first = rows.groupBy(F.lower(F.trim("city")).alias("own")).agg(F.min_by("station", "ordinal").alias("station"))
    listed = F.array_append(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("station.station_id")), F.col("station.station_name"))
    claims = rows.select("ordinal", F.lower(F.trim("city")).alias("own"), F.explode(listed).alias("alias"))
    claims = claims.where("alias IS NOT NULL").groupBy(F.lower("alias").alias("alias")).agg(F.max_by("own", "ordinal").alias("own"))
    own = first.select(F.col("own").alias("alias"), "own")
    names = own.unionByName(claims.join(own.select("alias"), "alias", "left_anti"))
    by_alias = names.join(first, "own").select(F.col("alias").alias("__alias"), F.col("station").alias("__city"))
    by_id = rows.groupBy(F.upper("station.station_id").alias("__id")).agg(F.max_by("station", "ordinal").alias("__station"))
    return by_alias, by_id


def market_specs(
    df: DataFrame, text: str, stations: DataFrame, question: str | None = None, outcomes: str | None = None, timezone: str | None = None
) -> DataFrame:
    """Add the struct ``spec`` with the facts of one market per row.

    ``text`` is a rule text or page; ``question``, ``outcomes`` (labels) and ``timezone`` are the market's own where it has
    them, else lines of the text. The station's name comes from the text, from its code, or from the city's
    station; its id from the source's address, from the text, or from the city's station. ``error`` names the first thing
    that is missing; the other fields are filled as far as they are known. A null text gives ``missing_question`` unless
    the market has its own.
    """
    by_alias, by_id = registry(stations)
    null = F.lit(None).cast("string")
    out = df.withColumn("__text", plain_text(F.coalesce(F.col(text), F.lit(""))))
    own = F.when(F.trim(F.col(question)) != "", F.col(question)) if question else null
    raw = F.col("__text")
    out = out.withColumn("__r", parse_rules(raw, own))
    r, source = F.col("__r"), F.col("__r.source_name")
    hko, noaa, cwa = source.startswith("Hong Kong"), source == "NOAA Timeseries", source.startswith("Central")
    code = F.when(hko, F.upper(found(raw, LETTER_STATION))).when(noaa, F.upper(found(raw, SITE_CODE))).when(cwa, found(raw, DIGIT_STATION))
    out = out.withColumn("__name", F.coalesce(r["station_name"], code))
    out = out.join(by_alias, F.lower(F.trim("__r.city")) == by_alias["__alias"], "left")
    out = out.withColumn("__name", F.coalesce("__name", "__city.station_name"))
    out = out.withColumn("__sid", F.coalesce("__r.station_id", "__city.station_id", "__name"))
    out = out.join(by_id, F.upper(F.trim("__sid")) == by_id["__id"], "left")
    known = F.coalesce("__station", "__city")
    out = out.withColumn("__known", known)
    k = F.col("__known")

    lines = F.filter(F.transform(F.split(raw, "\n"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit("°")))
    labels = F.when(F.size(F.col(outcomes)) > 0, F.col(outcomes)).otherwise(lines) if outcomes else lines
    out = out.withColumn("__labels", labels)
    units = F.array_distinct(F.filter(F.transform("__labels", label_unit), lambda u: u.isNotNull()))
    unit = F.when(F.size(units) == 1, F.get(units, F.lit(0))).otherwise("C")
    out = out.withColumn("__unit", unit)
    bins = F.transform("__labels", lambda x: parse_label(x, F.col("__unit")))
    ranged = F.exists(bins, lambda b: b["lower"].isNotNull() & b["upper"].isNotNull() & (b["lower"] != b["upper"]))
    given = F.col(timezone) if timezone else null
    zone = F.coalesce(F.when(given != "UTC", given), F.col("__station.timezone"), F.col("__city.timezone"), given, F.lit("UTC"))
    error = (
        F.when(r["question"].isNull(), "missing_question")
        .when(r["city"].isNull(), "unsupported_question")
        .when(r["target_date"].isNull(), "missing_date")
        .when(source.isNull(), "unsupported_source")
        .when(F.col("__name").isNull(), "missing_station_name")
        .when((source == "Wunderground") & k.isNull(), "unknown_station")
        .when(F.size("__labels") == 0, "missing_outcomes")
    )
    spec = F.struct(
        r["question"].alias("question"),
        F.coalesce(k["city"], F.trim(r["city"])).alias("city"),
        r["target_date"].alias("target_date"),
        source.alias("source_name"),
        r["source_url"].alias("source_url"),
        F.coalesce(k["station_name"], F.col("__name")).alias("station_name"),
        F.col("__sid").alias("station_id"),
        zone.alias("timezone"),
        k["country"].alias("country"),
        k["lat"].alias("lat"),
        k["lon"].alias("lon"),
        F.col("__labels").alias("outcomes"),
        F.col("__unit").alias("unit"),
        F.when(ranged, 2.0).otherwise(1.0).alias("step"),
        F.when(ranged, "range_bin").otherwise("whole_degree").alias("rounding"),
        r["precision_text"].alias("precision_text"),
        r["wait_for_finalized"].alias("wait_for_finalized"),
        r["ignore_late_revision"].alias("ignore_late_revision"),
        r["truth_track"].alias("truth_track"),
        r["settlement_eligible"].alias("settlement_eligible"),
        F.coalesce(k["public_truth_source_name"], source).alias("public_truth_source_name"),
        F.coalesce(k["public_truth_station_id"], F.col("__sid")).alias("public_truth_station_id"),
        error.alias("error"),
    )
    return out.select(*df.columns, spec.alias("spec"))
