"""Label, rule-text, clock and identity expressions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import clock as C
from skyledger.functions import labels as L
from skyledger.operators import rules as RU
from skyledger.plans import roles
from skyledger.plans.registry import query
from skyledger.plans.roles import with_roles
from skyledger.sources.tables import table


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


# --- labels ------------------------------------------------------------------------

LABEL_SQL = """lab AS (SELECT p_partkey, p_brand, p_type, p_size, CASE p_type WHEN 'ECONOMY' THEN p_size || '°C or below' WHEN 'LARGE' THEN ' ' || p_size || '  ° f  or  Higher ' WHEN 'MEDIUM' THEN '≤ ' || p_size || '°C'
    WHEN 'PROMO' THEN '> ' || p_size WHEN 'SMALL' THEN p_size || '–' || (p_size + 1) || '°F' ELSE CASE WHEN p_size < 25 THEN CAST(p_size AS VARCHAR) ELSE 'about ' || p_size END END AS label FROM part)"""


def labels(spark, sf):
    n = F.col("p_size").cast("string")
    t = F.col("p_type")
    text = (
        F.when(t == "ECONOMY", F.concat(n, F.lit("°C or below")))
        .when(t == "LARGE", F.concat(F.lit(" "), n, F.lit("  ° f  or  Higher ")))
        .when(t == "MEDIUM", F.concat(F.lit("≤ "), n, F.lit("°C")))
        .when(t == "PROMO", F.concat(F.lit("> "), n))
        .when(t == "SMALL", F.concat(n, F.lit("–"), (F.col("p_size") + 1).cast("string"), F.lit("°F")))
        .otherwise(F.when(F.col("p_size") < 25, n).otherwise(F.concat(F.lit("about "), n)))
    )
    return table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_name", text.alias("label"))


@query(
    "s01_outcome_labels",
    f"""WITH {LABEL_SQL}, u AS (SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'MEDIUM') THEN 'C' WHEN p_type IN ('LARGE', 'SMALL') THEN 'F' END AS own, p_name, min(CASE WHEN p_type IN ('ECONOMY', 'MEDIUM') THEN 'C' WHEN p_type IN ('LARGE', 'SMALL') THEN 'F' END) OVER (PARTITION BY p_name) AS lo,
      max(CASE WHEN p_type IN ('ECONOMY', 'MEDIUM') THEN 'C' WHEN p_type IN ('LARGE', 'SMALL') THEN 'F' END) OVER (PARTITION BY p_name) AS hi FROM part)
    SELECT p_partkey, CASE WHEN p_type IN ('LARGE', 'PROMO', 'SMALL') OR (p_type = 'STANDARD' AND p_size < 25) THEN CAST(p_size AS DOUBLE) END AS lower,
    CASE WHEN p_type IN ('ECONOMY', 'MEDIUM') OR (p_type = 'STANDARD' AND p_size < 25) THEN CAST(p_size AS DOUBLE) WHEN p_type = 'SMALL' THEN p_size + 1.0::DOUBLE END AS upper, p_type <> 'PROMO' AS lower_inclusive, true AS upper_inclusive,
    CASE WHEN p_type = 'STANDARD' AND p_size >= 25 THEN NULL ELSE coalesce(own, CASE WHEN lo = hi THEN lo ELSE 'C' END) END AS unit, CASE WHEN p_type = 'STANDARD' AND p_size >= 25 THEN 'Unsupported outcome label: ' || label END AS error
    FROM lab JOIN u USING (p_partkey)""",
)
def s01(spark, sf):
    """Label texts to bins; the unit comes from the label, else from its peers."""
    out = L.parse_label_table(labels(spark, sf), ["p_name"], "label")
    return out.select("p_partkey", "lower", "upper", "lower_inclusive", "upper_inclusive", "unit", "error")


# --- rule texts -----------------------------------------------------------------------

RULE_CITIES = ["Seoul", "New York", "Hong Kong", "Taipei"]


def rules(spark, sf):
    """Rule texts around the documents: the whole document text follows the rules."""
    d = table(spark, sf, "documents")
    lang = F.col("lang")
    city = F.when(lang == "en", "Seoul").when(lang == "fr", "New York").when(lang == "de", "Hong Kong").otherwise("Taipei")
    dom = F.col("doc_id") % 28 + 1
    question = F.concat(F.lit("Highest temperature in "), city, F.lit(" on December "), dom.cast("string"), F.lit("?"))
    dated = F.concat(F.lit("on "), dom.cast("string"), F.lit(" Dec '25"))
    source = (
        F.when(lang == "en", "Wunderground, recorded at the Incheon Intl Airport Station in degrees, https://www.wunderground.com/history/daily/kr/incheon/RKSI).")
        .when(lang == "fr", "information from NOAA recorded by NOAA at the LaGuardia Airport in degrees https://www.weather.gov/wrh/timeseries?site=KLGA")
        .when(lang == "de", "the Hong Kong Observatory daily extract https://www.weather.gov.hk/en/cis/dailyExtract.htm, station HKA")
        .otherwise("the Central Weather Administration, station 466920")
    )
    final = F.when(F.col("n_chars") > 1000, 'This market can not resolve to "Yes" until all data for this date has been finalized. Any revisions made after data is finalized for this date will not be considered.').otherwise("")
    degrees = F.when(F.col("n_chars") > 500, "The source measures temperatures to whole degrees Celsius.").otherwise("")
    text = F.concat_ws("\n", question, F.concat(F.lit("Resolves by the high "), dated, F.lit(" per "), source), degrees, final, "text")
    return d.select("doc_id", "n_chars", text.alias("rules"))


@query(
    "s02_rule_texts",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'Seoul' WHEN 'fr' THEN 'New York' WHEN 'de' THEN 'Hong Kong' ELSE 'Taipei' END AS city, strftime(DATE '2025-12-01' + CAST(doc_id % 28 AS INT), '%Y-%m-%d') AS target_date,
    CASE lang WHEN 'en' THEN 'Wunderground' WHEN 'fr' THEN 'NOAA Timeseries' WHEN 'de' THEN 'Hong Kong Observatory Daily Extract' ELSE 'Central Weather Administration' END AS source_name,
    CASE lang WHEN 'en' THEN 'RKSI' WHEN 'fr' THEN 'KLGA' WHEN 'de' THEN 'HKA' ELSE '466920' END AS station_id, CASE lang WHEN 'en' THEN 'Incheon Intl Airport' WHEN 'fr' THEN 'LaGuardia Airport' END AS station_name,
    n_chars > 1000 AS wait_for_finalized, CASE WHEN n_chars > 500 THEN 'measures temperatures to whole degrees Celsius' ELSE 'exact_source' END AS precision_text, lang <> 'en' AS settlement_eligible FROM documents""",
)
def s02(spark, sf):
    """Facts of whole rule texts: city, date, source, station and policies."""
    out = rules(spark, sf).select("doc_id", L.parse_rules(F.col("rules")).alias("r"))
    return out.select(
        "doc_id", "r.city", day("r.target_date").alias("target_date"), "r.source_name", "r.station_id", "r.station_name",
        "r.wait_for_finalized", "r.precision_text", "r.settlement_eligible",
    )


STATIONS = [
    (0, "Seoul", ["seoul, korea"], "South Korea", "Asia/Seoul", "RKSI", "Incheon Intl Airport", 37.46, 126.44, "AIR_CALP", "RKSI"),
    (1, "New York", ["nyc", "new york city"], "United States", "America/New_York", "KLGA", "LaGuardia Airport", 40.78, -73.87, None, None),
    (2, "Hong Kong", [], "Hong Kong", "Asia/Hong_Kong", "HKO", "Hong Kong Observatory", 22.3, 114.17, None, None),
]
STATION_COLUMNS = "ordinal int, city string, aliases array<string>, country string, timezone string, station_id string, station_name string, lat double, lon double, public_truth_source_name string, public_truth_station_id string"


def ladder_texts(spark, sf):
    """Rule texts of six kinds around the documents: by address, site, letters, digits, city alone, and an unknown station."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    kind = F.col("doc_id") % 6
    city = F.when(kind.isin(0, 5), "Seoul, Korea").when(kind.isin(1, 4), "NYC").when(kind == 2, "Hong Kong").otherwise("Taipei")
    body = (
        F.when(kind == 0, "Wunderground: https://www.wunderground.com/history/daily/kr/incheon/RKSI.")
        .when(kind == 1, "information from NOAA, recorded by NOAA at the La Guardia in degrees, https://www.weather.gov/wrh/timeseries?site=klga")
        .when(kind == 2, "the Hong Kong Observatory daily extract, station HKA")
        .when(kind == 3, "the Central Weather Administration, station 466920")
        .when(kind == 4, "Wunderground, whatever it says")
        .otherwise("Wunderground: https://www.wunderground.com/history/daily/xx/nowhere/ZZZZ/")
    )
    asked = F.concat(F.lit("Highest temperature in "), city, F.lit(" on December 5?"))
    lines = F.concat_ws("\n", asked, F.lit("Resolves on 5 Dec '25 by"), body, F.lit("20°C or below"), F.when(F.col("n_chars") % 2 == 0, "21–22°C").otherwise("-1°C"), F.lit("23°C or higher"))
    page = F.concat(F.lit("<html><head><style>p{x:1}</style></head><body><p>"), F.regexp_replace(F.replace(lines, F.lit("°"), F.lit("&deg;")), "\n", "</p><p>"), F.lit("</p></body></html>"))
    return d.withColumn("rules", F.when(F.col("n_chars") % 3 == 0, page).otherwise(lines))


@query(
    "s02_station_ladder",
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Seoul' WHEN 1 THEN 'New York' WHEN 2 THEN 'Hong Kong' WHEN 3 THEN 'Taipei' WHEN 4 THEN 'New York' ELSE 'Seoul' END AS city,
    CASE doc_id % 6 WHEN 0 THEN 'Incheon Intl Airport' WHEN 1 THEN 'LaGuardia Airport' WHEN 2 THEN 'Hong Kong Observatory' WHEN 3 THEN '466920' WHEN 4 THEN 'LaGuardia Airport' ELSE 'Incheon Intl Airport' END AS station_name,
    CASE doc_id % 6 WHEN 0 THEN 'RKSI' WHEN 1 THEN 'KLGA' WHEN 2 THEN 'HKA' WHEN 3 THEN '466920' WHEN 4 THEN 'KLGA' ELSE 'ZZZZ' END AS station_id,
    CASE doc_id % 6 WHEN 0 THEN 'Asia/Seoul' WHEN 1 THEN 'America/New_York' WHEN 2 THEN 'Asia/Hong_Kong' WHEN 3 THEN 'UTC' WHEN 4 THEN 'America/New_York' ELSE 'Asia/Seoul' END AS timezone,
    CASE doc_id % 6 WHEN 0 THEN 'AIR_CALP' WHEN 5 THEN 'AIR_CALP' WHEN 1 THEN 'NOAA Timeseries' WHEN 4 THEN 'Wunderground' WHEN 2 THEN 'Hong Kong Observatory Daily Extract' ELSE 'Central Weather Administration' END AS public_truth_source_name, NULL::VARCHAR AS error FROM documents""",
)
def s02l(spark, sf):
    """City, station and time zone by address, text or registry, also from pages."""
    out = RU.market_specs(ladder_texts(spark, sf), "rules", spark.createDataFrame(STATIONS, STATION_COLUMNS))
    return out.select("doc_id", *[f"spec.{c}" for c in ("city", "station_name", "station_id", "timezone", "public_truth_source_name", "error")])


@query(
    "s02_precision",
    "SELECT doc_id, 'C' AS unit, CASE WHEN n_chars % 2 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS step, CASE WHEN n_chars % 2 = 0 THEN 'range_bin' ELSE 'whole_degree' END AS rounding, 3 AS outcomes FROM documents",
)
def s02p(spark, sf):
    """Unit and precision from the outcome lines of a rule text."""
    out = RU.market_specs(ladder_texts(spark, sf), "rules", spark.createDataFrame(STATIONS, STATION_COLUMNS))
    return out.select("doc_id", "spec.unit", "spec.step", "spec.rounding", F.size("spec.outcomes").alias("outcomes"))


@query(
    "f06_temperature_markets",
    "SELECT doc_id, lang IN ('en', 'de', 'es') AND doc_id % 28 < 14 AS is_market FROM documents",
)
def f06(spark, sf):
    """Daily-high markets by question, source and a degree label."""
    r = rules(spark, sf)
    question = F.regexp_extract("rules", r"(?m)^(Highest temperature.*)$", 1)
    outcomes = F.array(F.lit("Yes"), F.when(F.col("doc_id") % 28 < 14, "21°C or below").otherwise("21 or below"))
    return r.select("doc_id", L.is_temperature_market(question, F.col("rules"), outcomes).alias("is_market"))


@query(
    "s43_source_families",
    """SELECT lang, CASE lang WHEN 'en' THEN 'wunderground' WHEN 'fr' THEN 'noaa' WHEN 'de' THEN 'hko' ELSE 'cwa' END AS adapter,
    CASE WHEN lang = 'en' THEN CASE WHEN doc_id % 28 < 10 THEN 'amo_air_calp' ELSE 'noaa_global_hourly' END WHEN lang = 'fr' THEN 'noaa_global_hourly' WHEN lang = 'de' THEN 'hko' ELSE 'cwa' END AS truth_source, count(*) AS n FROM documents GROUP BY ALL""",
)
def s43(spark, sf):
    """Source family of a rule text and the truth adapter it leads to."""
    family = L.parse_rules(F.col("rules"))["source_name"]
    r = rules(spark, sf).withColumn("f", family).withColumn("public", F.when(F.col("doc_id") % 28 < 10, "AMO AIR_CALP"))
    track = F.when(F.col("f") == "Wunderground", "research_public").otherwise("exact_public")
    lang = table(spark, sf, "documents", ["doc_id", "lang"])
    return r.join(lang, "doc_id").groupBy(
        "lang", L.adapter_key(F.col("f")).alias("adapter"), L.truth_source_key(F.col("f"), F.col("public"), track).alias("truth_source")
    ).agg(F.count("*").alias("n"))


@query(
    "s33_safe_names",
    "SELECT page_id, coalesce(nullif(trim(regexp_replace(lower(trim(url)), '[^0-9a-z]+', '_', 'g'), '_'), ''), 'unknown') AS token, coalesce(nullif(trim(lower(regexp_replace(trim(url), '[^\\p{L}\\p{N}]', '_', 'g')), '_'), ''), 'item') AS slug FROM pages",
)
def s33(spark, sf):
    return table(spark, sf, "pages").select("page_id", L.safe_token(F.col("url")).alias("token"), L.safe_slug(F.col("url")).alias("slug"))


@query(
    "s34_availability_status",
    """SELECT o_orderkey, CASE WHEN s IN (404, 422) OR (s = 400 AND o_totalprice > 100000) THEN 'unavailable' ELSE 'error' END AS status FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 400 WHEN 'O' THEN 404 ELSE 500 END AS s FROM orders)""",
)
def s34(spark, sf):
    s = F.when(F.col("o_orderstatus") == "F", 400).when(F.col("o_orderstatus") == "O", 404).otherwise(500)
    why = F.when(F.col("o_totalprice") > 100000, "No data is available for this location").otherwise("bad request")
    return table(spark, sf, "orders").select("o_orderkey", L.availability_status(s, why).alias("status"))


# Priority of a source when rows of one key meet.
SOURCE_PRIORITY = {"fixture": 5, "forecast": 60, "historical_forecast": 80, "single_run": 90, "snapshot": 95, "build_dataset": 95, "scan": 95, "wunderground": 100, "hko": 100, "cwa": 100}


@query("s35_source_priority", with_roles("hourly", "SELECT endpoint_kind, CASE endpoint_kind WHEN 'fixture' THEN 5 WHEN 'historical_forecast' THEN 80 WHEN 'single_run' THEN 90 ELSE 50 END AS priority, count(*) AS n FROM hourly GROUP BY ALL"))
def s35(spark, sf):
    h = roles.hourly(spark, sf)
    return h.groupBy("endpoint_kind", L.lookup(F.col("endpoint_kind"), SOURCE_PRIORITY, 50).alias("priority")).agg(F.count("*").alias("n"))


@query(
    "s41_request_signatures",
    """SELECT o_orderkey, sha256('{"custkey":' || o_custkey || ',"day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","priority":"' || o_orderpriority || '","status":' || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}') AS signature FROM orders""",
)
def s41(spark, sf):
    """Stable hash of the named request fields, nulls included."""
    return table(spark, sf, "orders").select(
        "o_orderkey",
        L.signature(
            F.col("o_custkey").alias("custkey"), day("o_orderdate").alias("day"), F.col("o_orderpriority").alias("priority"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"),
        ).alias("signature"),
    )


@query("s42_group_ids", "SELECT o_orderkey, o_custkey || '|' || strftime(o_orderdate, '%Y-%m-%d') AS group_id FROM orders")
def s42(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", L.group_id(F.col("o_custkey"), F.to_date("o_orderdate")).alias("group_id"))


@query("s45_market_units", "SELECT event_id, CASE event_type WHEN 'click' THEN 'F' ELSE 'C' END AS unit FROM events")
def s45(spark, sf):
    """Unit of a nested spec, Celsius by default."""
    spec = F.when(F.col("event_type") == "click", '{"unit": "F", "city": "NYC"}').when(F.col("event_type") == "view", "{}").otherwise("not json")
    return table(spark, sf, "events").select("event_id", L.market_unit(spec).alias("unit"))


@query("s47_market_cities", "SELECT event_id, CASE event_type WHEN 'click' THEN 'NYC' WHEN 'view' THEN 'own' ELSE 'unknown' END AS city FROM events")
def s47(spark, sf):
    spec = F.when(F.col("event_type") == "click", '{"unit": "F", "city": "NYC"}').otherwise("{}")
    own = F.when(F.col("event_type") == "view", "own")
    return table(spark, sf, "events").select("event_id", L.market_city(own, spec).alias("city"))


@query(
    "s30_market_volume",
    "SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN CAST(max(l_quantity) AS DOUBLE) ELSE sum(CASE WHEN l_discount > 0 THEN l_quantity ELSE 0 END) END AS volume FROM lineitem GROUP BY 1",
)
def s30(spark, sf):
    """Own volume, else the sum over component markets."""
    v = F.collect_list(F.when(F.col("l_discount") > 0, F.col("l_quantity")).otherwise(0.0))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(v.alias("parts"), F.max("l_quantity").alias("top"))
    own = F.when(F.col("l_orderkey") % 2 == 0, F.col("top"))
    return g.select("l_orderkey", L.market_volume(own, F.col("parts")).alias("volume"))


@query(
    "q06_retryable",
    """SELECT o_orderstatus, o_orderpriority, o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderpriority < '3') AS retryable, o_orderpriority = '1-URGENT' AS lag, count(*) AS n FROM orders GROUP BY ALL""",
)
def q06(spark, sf):
    """Statuses a later run revisits, and messages of a lagging archive."""
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    status = F.when(s == "O", "truth_source_lag").when(s == "P", "parse_failed").otherwise("collected")
    detail = F.when(p < "3", "not_closed").otherwise("bad html")
    message = F.when(p == "1-URGENT", "No HKO record for 2025-01-01").otherwise("socket closed")
    return table(spark, sf, "orders").groupBy(
        "o_orderstatus", "o_orderpriority", L.retryable(status, detail).alias("retryable"), L.source_lag(message).alias("lag")
    ).agg(F.count("*").alias("n"))


# --- clock ------------------------------------------------------------------------------

ZONE_SQL = "CASE r_name WHEN 'AMERICA' THEN 'America/New_York' WHEN 'ASIA' THEN 'Asia/Seoul' WHEN 'EUROPE' THEN 'Europe/London' ELSE 'Asia/Dubai' END"


def zone(country="country"):
    c = F.col(country)
    return F.when(c == "AMERICA", "America/New_York").when(c == "ASIA", "Asia/Seoul").when(c == "EUROPE", "Europe/London").otherwise("Asia/Dubai")


def zoned_orders(spark, sf):
    o = table(spark, sf, "orders").join(roles.cities(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    return o.withColumn("zone", zone()).withColumn("target_date", F.to_date("o_orderdate"))


ZONED = f"z AS (SELECT o.*, {ZONE_SQL} AS zone FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(
    "s06_decision_points",
    f"""WITH {ZONED}, p AS (SELECT o_orderkey, zone, CAST(o_orderdate AS DATE) AS d, h.* FROM z, (VALUES ('market_open', -2, 12), ('previous_evening', -1, 18), ('morning_of', 0, 6), ('hourly_refresh', 0, 9)) h(horizon, days, hr)),
    q AS (SELECT *, epoch_us(timezone(zone, CAST(d + days AS TIMESTAMP) + to_hours(hr))) AS dec_us, epoch_us(timezone(zone, CAST(d AS TIMESTAMP))) AS mid_us FROM p)
    SELECT o_orderkey, horizon, dec_us AS decision_us, dec_us - 21600000000 AS issue_us, greatest((mid_us - dec_us) / 3600000000, 1.0)::DOUBLE AS lead_hours FROM q""",
)
def s06(spark, sf):
    """Decision, issue and lead of every horizon on the local clock."""
    o = zoned_orders(spark, sf).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in C.HORIZON_OFFSETS])))
    out = o.withColumn("p", C.decision_point(F.col("target_date"), F.col("horizon"), F.col("zone")))
    return out.select(
        "o_orderkey", "horizon", F.unix_micros("p.decision_time_utc").alias("decision_us"),
        F.unix_micros("p.issue_time_utc").alias("issue_us"), "p.lead_hours",
    )


@query(
    "s07_local_to_utc",
    f"""WITH {ZONED}, l AS (SELECT o_orderkey, zone, h.hr, CAST(o_orderdate AS TIMESTAMP) + to_hours(h.hr) AS wall FROM z, (VALUES (1), (2), (3), (14)) h(hr)),
    u AS (SELECT *, epoch_us(timezone(zone, wall)) AS us FROM l),
    c AS (SELECT *, timezone(zone, make_timestamptz(us)) AS back, timezone(zone, make_timestamptz(us + 3600000000)) AS later, timezone(zone, make_timestamptz(us - 3600000000)) AS earlier FROM u)
    SELECT zone, hr, count(*) AS n, count(CASE WHEN back <> wall THEN 1 WHEN later <> wall AND earlier <> wall THEN 1 END) AS kept, count(CASE WHEN back <> wall THEN 1 END) AS shifted,
    CAST(sum(CASE WHEN back <> wall OR (later <> wall AND earlier <> wall) THEN us // 1000000 - epoch(wall)::BIGINT END) AS BIGINT) AS offsets FROM c GROUP BY ALL""",
)
def s07(spark, sf):
    """Local hours around the clock changes: ambiguous null, missing moved on."""
    o = zoned_orders(spark, sf).withColumn("hr", F.explode(F.array(*[F.lit(h) for h in (1, 2, 3, 14)])))
    wall = F.timestamp_seconds(F.unix_timestamp("o_orderdate") + F.col("hr") * 3600).cast("timestamp_ntz")
    o = o.withColumn("wall", wall).withColumn("utc", C.local_to_utc(F.col("wall"), F.col("zone")))
    gap = F.from_utc_timestamp(F.to_utc_timestamp("wall", F.col("zone")), F.col("zone")) != F.col("wall").cast("timestamp")
    return o.groupBy("zone", "hr").agg(
        F.count("*").alias("n"),
        F.count("utc").alias("kept"),
        F.count(F.when(gap, 1)).alias("shifted"),
        F.sum(F.unix_timestamp("utc") - F.unix_timestamp(F.col("wall").cast("timestamp"))).alias("offsets"),
    )


@query(
    "s08_candidate_horizons",
    f"""WITH {ZONED}, d AS (SELECT o_orderkey, date_diff('day', CAST(timezone(zone, TIMESTAMPTZ '1998-07-01 20:00:00+00') AS DATE), CAST(o_orderdate AS DATE)) AS dist FROM z)
    SELECT o_orderkey, dist AS distance, CASE WHEN dist = 0 THEN 'morning_of' WHEN dist = 1 THEN 'previous_evening' WHEN dist >= 2 THEN 'market_open' END AS horizon,
    CASE WHEN dist > 3 THEN NULL WHEN dist = 0 THEN 'morning_of' WHEN dist = 1 THEN 'previous_evening' WHEN dist >= 2 THEN 'market_open' END AS near_horizon FROM d""",
)
def s08(spark, sf):
    """Horizon by local days to the target, and its near-term variant."""
    now = F.lit("1998-07-01 20:00:00").cast("timestamp")
    o = zoned_orders(spark, sf).withColumn("dist", C.target_day_distance(F.col("target_date"), now, F.col("zone")))
    return o.select(
        "o_orderkey", F.col("dist").cast("bigint").alias("distance"), C.candidate_horizon(F.col("dist")).alias("horizon"), C.candidate_horizon(F.col("dist"), 3).alias("near_horizon")
    )


@query("s09_day_cycle", "SELECT o_orderkey, round(sin(2 * pi() * dayofyear(o_orderdate) / 366), 9) AS s, round(cos(2 * pi() * dayofyear(o_orderdate) / 366), 9) AS c, CAST(month(o_orderdate) AS INT) AS m FROM orders")
def s09(spark, sf):
    s, c = C.day_cycle(F.col("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", F.round(s, 9).alias("s"), F.round(c, 9).alias("c"), F.month("o_orderdate").alias("m"))


@query(
    "w19_listing_ages",
    """WITH t AS (SELECT l_orderkey, min(CASE WHEN l_returnflag = 'A' THEN l_shipdate END) AS a, min(CASE WHEN l_returnflag = 'N' THEN l_shipdate END) AS c, min(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS d FROM lineitem GROUP BY 1)
    SELECT l_orderkey, epoch_us(coalesce(a, c, d)) AS opened_us, CASE WHEN date_diff('hour', coalesce(a, c, d), TIMESTAMP '1998-01-03') <= 6 THEN '0-6h' WHEN date_diff('hour', coalesce(a, c, d), TIMESTAMP '1998-01-03') <= 24 THEN '6-24h' WHEN date_diff('hour', coalesce(a, c, d), TIMESTAMP '1998-01-03') <= 48 THEN '24-48h' ELSE '48h+' END AS bucket FROM t""",
)
def w19(spark, sf):
    """Earliest component time by precedence, and the age bucket."""
    li = table(spark, sf, "lineitem").withColumn("iso", F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))

    def times(flag):
        return F.collect_list(F.when(F.col("l_returnflag") == flag, F.col("iso")).otherwise("unknown"))

    g = li.groupBy("l_orderkey").agg(times("A").alias("a"), times("N").alias("c"), times("R").alias("d"))
    g = g.withColumn("opened", C.opened_at(*[C.earliest(F.col(x)) for x in "acd"]))
    hours = C.hours_between(F.lit("1998-01-03").cast("timestamp"), F.col("opened"))
    return g.select("l_orderkey", F.unix_micros("opened").alias("opened_us"), C.age_bucket(hours).alias("bucket"))


@query(
    "f07_open_window",
    "SELECT event_id, round((epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)) / 3600000000, 6) AS age_hours FROM events WHERE ts <= TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2024-01-18 12:00:00'",
)
def f07(spark, sf):
    """Listings at most 36 hours old."""
    age = C.hours_between(F.lit("2024-01-20").cast("timestamp"), F.col("ts"))
    e = table(spark, sf, "events").withColumn("age_hours", age).where((F.col("age_hours") >= 0) & (F.col("age_hours") <= 36))
    return e.select("event_id", F.round("age_hours", 6).alias("age_hours"))


@query(
    "f08_settlement_window",
    """WITH h AS (SELECT o_orderkey, greatest((epoch_us(o_orderdate) + 86399000000 - epoch_us(TIMESTAMP '1998-05-01 06:00:00')) / 3600000000, 0) AS hours FROM orders) SELECT o_orderkey, round(hours, 6) AS hours FROM h WHERE hours > 0 AND hours <= 48""",
)
def f08(spark, sf):
    """Markets that settle within 48 hours."""
    h = C.hours_to_settlement(F.to_date("o_orderdate"), F.lit("1998-05-01 06:00:00").cast("timestamp"))
    o = table(spark, sf, "orders").withColumn("hours", h).where((F.col("hours") > 0) & (F.col("hours") <= 48))
    return o.select("o_orderkey", F.round("hours", 6).alias("hours"))


@query(
    "w15_best_observation",
    """SELECT user_id, max(value) AS temp, epoch_us(arg_max(ts, (value, ts))) AS at_us, arg_max(event_type, (value, ts)) AS event_type FROM events GROUP BY 1""",
)
def w15(spark, sf):
    """Strongest observation per market: temperature, then time, then source."""
    best = F.max(F.struct("value", "ts", "event_type"))
    out = table(spark, sf, "events").groupBy("user_id").agg(best.alias("b"))
    return out.select("user_id", F.col("b.value").alias("temp"), F.unix_micros("b.ts").alias("at_us"), "b.event_type")


@query(
    "t07_freshness",
    "SELECT user_id, count(*) FILTER (epoch_us(ts) >= epoch_us(TIMESTAMP '2024-01-30 12:00:00') - 90 * 60000000::BIGINT AND ts <= TIMESTAMP '2024-01-30 12:00:00') AS fresh, count(*) AS n FROM events GROUP BY 1",
)
def t07(spark, sf):
    """Observations not older than 90 minutes at a moment."""
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    fresh = C.fresh(F.col("ts"), now, 90.0) & (F.col("ts") <= now)
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.when(fresh, 1)).alias("fresh"), F.count("*").alias("n"))
