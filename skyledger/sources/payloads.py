"""Landed payloads to rows: feeds of observations, forecasts, prices and books.

Parsers take a text column and stay in the JVM. A value that cannot be read
becomes null; nothing raises for one bad payload.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.labels import found
from skyledger.functions.numeric import let


def tenths(raw: Column) -> Column:
    """Quoted integer tenths of a degree; blanks are null."""
    return F.trim(F.regexp_replace(raw, '"', "")).try_cast("int") / 10.0


def daily_extremes(df: DataFrame, date: str = "TM", value: str = "TMP_MAX") -> DataFrame:
    """Daily maxima of a CSV feed (dates as yyyyMMdd, tenths of a degree)."""
    day = F.to_date(F.try_to_timestamp(F.trim(F.col(date)), F.lit("yyyyMMdd")))
    return df.withColumn("observed_date", day).withColumn("daily_max", tenths(F.col(value)))


def station_temperature(raw: Column) -> Column:
    """Signed tenths before the first comma; 9999 is missing."""
    text = F.trim(F.element_at(F.split(raw, ",", 2), 1))
    return F.when(~text.isin("+9999", "-9999", "9999"), text.try_cast("int") / 10.0)


def station_day_values(df: DataFrame, payload: str, zone: str) -> DataFrame:
    """Readings of an hourly station feed with their local date."""
    rows = F.from_json(payload, "array<struct<DATE:string,TMP:string>>")
    out = df.withColumn("__r", F.explode(rows)).withColumn("observed_at", F.try_to_timestamp(F.col("__r.DATE")))
    return (
        out.withColumn("local_date", F.to_date(F.from_utc_timestamp("observed_at", zone)))
        .withColumn("temperature", station_temperature(F.col("__r.TMP")))
        .where(F.col("observed_at").isNotNull() & F.col("temperature").isNotNull())
        .drop("__r")
    )


def monthly_values(df: DataFrame, payload: str) -> DataFrame:
    """Rows ``[year, month, day, value]`` of a monthly feed; bad dates are dropped."""
    rows = F.from_json(payload, "struct<data:array<array<string>>>")["data"]
    out = df.withColumn("__r", F.explode(rows))
    part = lambda i: F.get("__r", F.lit(i))
    text = F.concat_ws("-", *[F.lpad(part(i), n, "0") for i, n in ((0, 4), (1, 2), (2, 2))])
    day = F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    return out.withColumn("observed_date", day).withColumn("daily_max", part(3).try_cast("double")).where(
        F.col("observed_date").isNotNull()
    ).drop("__r")


STATION_DAILY = (
    "struct<code:int,data:array<struct<dts:array<struct<DataDate:string,"
    "AirTemperature:struct<Maximum:double,MaximumTime:string>>>>>>"
)


def nested_daily(df: DataFrame, payload: str) -> DataFrame:
    """Daily maxima of a nested station feed; only payloads with code 200 count."""
    p = F.from_json(payload, STATION_DAILY)
    out = df.withColumn("__p", p).where(F.col("__p.code") == 200)
    out = out.withColumn("__s", F.explode("__p.data")).withColumn("__d", F.explode("__s.dts"))
    return out.select(
        *df.columns,
        F.substring("__d.DataDate", 1, 10).try_cast("date").alias("observed_date"),
        F.col("__d.AirTemperature.Maximum").alias("daily_max"),
        F.col("__d.AirTemperature.MaximumTime").alias("max_time"),
    )


# Marker of an empty page and the two ways a page states its maximum.
EMPTY_PAGE = "No Data Recorded"
PAGE_MAXIMUM = (
    r'(?i)"temperatureMax"\s*:\s*\{"value"\s*:\s*(-?\d+(?:\.\d+)?)',
    r'(?i)"temperatureMax"\s*:\s*(-?\d+(?:\.\d+)?)',
)


def page_maximum(html: Column) -> Column:
    """Struct of the first stated maximum of a page and an error text."""
    value = F.coalesce(*[found(html, p).try_cast("double") for p in PAGE_MAXIMUM])
    usable = F.when(~F.contains(html, F.lit(EMPTY_PAGE)), value)
    return F.struct(
        usable.alias("daily_max"),
        F.when(usable.isNull(), "Could not parse Wunderground daily max").alias("error"),
    )


def observations_maximum(payload: Column) -> Column:
    """Greatest temperature of an observation list, null without any."""
    rows = F.from_json(payload, "struct<observations:array<struct<temp:string>>>")["observations"]
    return F.array_max(F.transform(rows, lambda r: r["temp"].try_cast("double")))


def aviation_report(payload: Column, received: Column) -> Column:
    """Struct of one decoded report: alternate field names, epoch or ISO time.

    A report without a readable time counts as observed when received.
    """
    p = F.from_json(
        payload,
        "struct<icaoId:string,stationId:string,temp:string,obsTime:string,reportTime:string,dewp:string,wspd:string,rawOb:string>",
    )
    def filled(c: Column) -> Column:
        return F.when(F.trim(c) != "", c)

    time = F.coalesce(filled(p["obsTime"]), filled(p["reportTime"]))
    epoch = time.try_cast("double")
    at = F.coalesce(F.timestamp_seconds(epoch), F.try_to_timestamp(F.when(epoch.isNull(), time)), received)
    return F.struct(
        F.coalesce(filled(p["icaoId"]), filled(p["stationId"])).alias("station_id"),
        at.alias("observed_at"),
        p["temp"].try_cast("double").alias("temp_c"),
        p["dewp"].try_cast("double").alias("dew_point_c"),
        p["wspd"].try_cast("double").alias("wind_speed_kt"),
    )


def price_history(df: DataFrame, payload: str) -> DataFrame:
    """Ticks of a price-history payload; points without time or price are dropped."""
    points = F.from_json(payload, "struct<history:array<struct<t:string,p:string>>>")["history"]
    out = df.withColumn("__h", F.explode(points))
    return (
        out.withColumn("timestamp", F.timestamp_seconds(F.col("__h.t").try_cast("double")))
        .withColumn("price", F.col("__h.p").try_cast("double"))
        .drop("__h")
        .where(F.col("timestamp").isNotNull() & F.col("price").isNotNull())
    )


def hourly_rows(df: DataFrame, payload: str, variables: Sequence[str]) -> DataFrame:
    """Columnar hourly arrays to one row per hour; a variable of another length is null."""
    fields = ",".join(["time:array<string>", *[f"{v}:array<double>" for v in variables]])
    h = df.withColumn("__h", F.from_json(payload, f"struct<hourly:struct<{fields}>>")["hourly"])
    n = F.size("__h.time")
    columns = [F.col("__h.time").alias("time")]
    for v in variables:
        values = F.col(f"__h.{v}")
        columns.append(F.when(F.size(values) == n, values).otherwise(F.array_repeat(F.lit(None).cast("double"), n)).alias(v))
    return h.where(n > 0).select(*df.columns, F.inline(F.arrays_zip(*columns)))


def last_trade(payload: Column) -> Column:
    """First usable price and side of alternate field names, with a presence flag."""
    price = F.coalesce(
        *[F.get_json_object(payload, f"$.{k}").try_cast("double") for k in ("price", "last_trade_price", "lastTradePrice")]
    )
    sides = [F.get_json_object(payload, f"$.{k}") for k in ("side", "last_trade_side", "lastTradeSide")]
    side = F.coalesce(*[F.when(s != "", s) for s in sides])
    return F.struct(price.alias("last_trade_price"), side.alias("last_trade_side"), price.isNotNull().alias("last_trade_present"))


def text_list(value: Column) -> Column:
    """A JSON text list as an array of texts; anything else is an empty array."""
    empty = F.array().cast("array<string>")
    return F.coalesce(F.from_json(value, "array<string>"), empty)


def outcome_prices(labels: Column, prices: Column) -> Column:
    """Array of (label, price) over the shorter list, unreadable prices dropped."""
    names = F.filter(F.transform(text_list(labels), lambda x: F.trim(x)), lambda x: x != "")
    values = text_list(prices)
    n = F.least(F.size(names), F.size(values))
    zipped = F.zip_with(
        F.slice(names, F.lit(1), n),
        F.slice(values, F.lit(1), n),
        lambda label, p: F.struct(label.alias("label"), p.try_cast("double").alias("price")),
    )
    return F.filter(zipped, lambda e: e["price"].isNotNull())


def grouped_event(payload: Column, source_url: Column | None = None) -> Column:
    """One market from a grouped event: a label, yes price and yes token per component.

    The label is the group title, else the words between ``be`` and ``on`` of the question. Prices are a list or
    a list kept as JSON text; tokens are a list. Ids, description and source fall back from the event to its first
    component (the description the other way round), the id at last to ``source_url``; empty texts count as missing.
    ``error`` is set where a component lacks a label, price or token, or the event a description.
    """
    parsed = F.from_json(
        payload,
        "struct<id:string,slug:string,title:string,negRiskMarketID:string,questionID:string,description:string,resolutionSource:string,"
        "markets:array<struct<groupItemTitle:string,question:string,outcomePrices:string,clobTokenIds:array<string>,description:string,"
        "questionID:string,conditionId:string,resolutionSource:string>>>",
    )

    def given(*values: Column) -> Column:
        return F.coalesce(*[F.when(v != "", v) for v in values])

    def component(m: Column) -> Column:
        title = F.trim(F.coalesce(m["groupItemTitle"], F.lit("")))
        asked = F.trim(F.regexp_extract(F.coalesce(m["question"], F.lit("")), r"(?i)be (.+?) on ", 1))
        return F.struct(
            given(title, asked).alias("label"),
            F.get(text_list(m["outcomePrices"]), F.lit(0)).alias("price"),
            F.get(m["clobTokenIds"], F.lit(0)).alias("token_id"),
        )

    def market(p: Column, parts: Column) -> Column:
        first = F.get(p["markets"], F.lit(0))
        broken = F.exists(parts, lambda c: c["label"].isNull() | c["price"].isNull() | c["token_id"].isNull())
        description = given(F.trim(given(first["description"], p["description"])))
        url = F.lit(None).cast("string") if source_url is None else source_url
        event_id = given(p["id"], p["slug"], first["questionID"], url)
        error = (
            F.when(F.coalesce(F.size(p["markets"]), F.lit(0)) <= 0, "missing_component_markets")
            .when(broken, "malformed_component_market")
            .when(description.isNull(), "missing_description")
        )
        return F.struct(
            event_id.alias("id"),
            F.trim(F.coalesce(p["slug"], F.lit(""))).alias("slug"),
            F.trim(F.coalesce(p["title"], F.lit(""))).alias("question"),
            given(p["negRiskMarketID"], p["questionID"], first["questionID"], first["conditionId"], event_id).alias("condition_id"),
            description.alias("description"),
            F.coalesce(given(first["resolutionSource"], p["resolutionSource"]), F.lit("")).alias("resolution_source"),
            parts.alias("outcomes"),
            error.alias("error"),
        )

    # parsed once and its components made once, however many fields of the result are read
    return let(parsed, lambda p: let(F.transform(p["markets"], component), lambda parts: market(p, parts)))


def book_payload(payload: Column, depth: int = 5) -> Column:
    """Order book of a payload: sorted levels, cut to a depth, millisecond time.

    Levels whose price or size is no number are left out.
    """
    from skyledger.operators.trade import normalize_levels

    level = "array<struct<price:string,size:string>>"
    p = F.from_json(payload, f"struct<bids:{level},asks:{level},timestamp:string>")

    def numeric(levels: Column) -> Column:
        read = F.transform(
            F.coalesce(levels, F.array().cast(level)),
            lambda lv: F.struct(lv["price"].try_cast("double").alias("price"), lv["size"].try_cast("double").alias("size")),
        )
        return F.filter(read, lambda lv: lv["price"].isNotNull() & lv["size"].isNotNull())

    return F.struct(
        normalize_levels(numeric(p["bids"]), "bid", depth).alias("bids"),
        normalize_levels(numeric(p["asks"]), "ask", depth).alias("asks"),
        F.timestamp_millis(p["timestamp"].try_cast("bigint")).alias("timestamp"),
    )


# Header and station line of the fixed-layout readings.
READINGS_HEADER = r"Latest readings recorded at\s+(\d{1,2}):(\d{2})\s+Hong Kong Time\s+(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})"
READINGS_TAIL = r"\s+(-?\d+(?:\.\d+)?)\s+(N/A|\d+)\s+(-?\d+(?:\.\d+)?)\s*/\s*(-?\d+(?:\.\d+)?)"


def station_readings(text: Column, label: str) -> Column:
    """Struct of the reading time (UTC) and one station's current, max and min."""
    import re

    part = lambda i: F.regexp_extract(text, READINGS_HEADER, i)
    stamp = F.concat(part(3), F.lit(" "), part(4), F.lit(" "), part(5), F.lit(" "), F.lpad(part(1), 2, "0"), F.lit(":"), part(2))
    local = F.try_to_timestamp(stamp, F.lit("d MMMM yyyy HH:mm"))
    line = rf"(?m)^\s*{re.escape(label)}" + READINGS_TAIL
    number = lambda i: F.regexp_extract(text, line, i).try_cast("double")
    return F.struct(
        F.to_utc_timestamp(local, "Asia/Hong_Kong").alias("observed_at"),
        number(1).alias("current"),
        number(3).alias("maximum"),
        number(4).alias("minimum"),
    )


def clock_time(date: Column, digits: Column, zone: str, fallback: Column) -> Column:
    """UTC instant of a local day and a time as up to four digits, else the fallback."""
    raw = F.trim(F.regexp_replace(digits, '"', ""))
    padded = F.lpad(raw, 4, "0")
    hour, minute = F.substring(padded, 1, 2).try_cast("int"), F.substring(padded, 3, 2).try_cast("int")
    valid = raw.rlike(r"^\d{1,4}$") & (hour < 24) & (minute < 60)
    local = F.try_to_timestamp(F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit(" "), padded), F.lit("yyyy-MM-dd HHmm"))
    return F.coalesce(F.when(valid, F.to_utc_timestamp(local, zone)), fallback)


def feed_freshness(df: DataFrame, station: str, date: str, wanted: Column) -> DataFrame:
    """Latest date per station against a wanted one: ready, lag or unknown."""
    out = df.groupBy(station).agg(F.max(date).alias("latest_available_date"))
    latest = F.col("latest_available_date")
    return out.withColumn("status", F.when(latest.isNull(), "unknown").when(latest >= wanted, "ready").otherwise("lag"))
