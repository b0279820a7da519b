"""Sources, sinks and payload parsers; payloads are built from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators.asof import source_bytes
from skyledger.plans.registry import query
from skyledger.session import scratch_path
from skyledger.sources import files as S
from skyledger.sources import payloads as P
from skyledger.sources.tables import read_table, replace_table, table
from skyledger.sources.versions import read_current


#: Bytes of a table whose payloads one task makes.
FEED_BYTES = 1 << 23


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


@query("i01_column_scan", "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def i01(spark, sf):
    """Two columns of a Parquet table."""
    li = read_table(spark, f"{sf}/lineitem.parquet", ["l_returnflag", "l_extendedprice"])
    return li.groupBy("l_returnflag").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("i02_replace_write", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def i02(spark, sf):
    """A table written twice holds the second version only."""
    path = scratch_path(spark, "events")
    e = table(spark, sf, "events")
    replace_table(e.where(F.col("event_type") == "click"), path)
    replace_table(e, path)
    return read_current(spark, path).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("i04_log_scan", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def i04(spark, sf):
    """JSON lines with blank and broken lines between the records."""
    path = scratch_path(spark, "log")
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    lines = e.select(F.explode(F.array(F.to_json(F.struct("*")), F.lit(""), F.lit("{broken"))).alias("value"))
    lines.write.text(path)
    log = S.read_log(spark, path, "event_id long, event_type string, value double").where(F.col("event_id").isNotNull())
    return log.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("i05_daily_log", "SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n FROM events GROUP BY 1")
def i05(spark, sf):
    """Append-only log partitioned by day, written in two appends."""
    path = scratch_path(spark, "daily")
    e = table(spark, sf, "events").select("event_id", "ts", "event_type")
    cut = F.lit("2024-01-15").cast("timestamp")
    S.append_log(e.where(F.col("ts") < cut), path, "ts")
    S.append_log(e.where(F.col("ts") >= cut), path, "ts")
    log = spark.read.schema("event_id long, event_type string, dt string").json(path)
    return log.groupBy("dt").agg(F.count("*").alias("n"))


@query("i06_report_rows", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1")
def i06(spark, sf):
    """Reports as a list, as an object with rows, or as single lines."""
    li = table(spark, sf, "lineitem")
    row = F.struct("l_returnflag", "l_quantity")
    per = li.groupBy("l_orderkey", "l_linestatus").agg(F.collect_list(row).alias("rows"))
    listed = per.where(F.col("l_linestatus") == "F").select(F.to_json("rows").alias("text"))
    nested = per.where(F.col("l_linestatus") == "O").where(F.size("rows") > 1).select(F.to_json(F.struct("rows")).alias("text"))
    single = per.where(F.col("l_linestatus") == "O").where(F.size("rows") == 1).select(F.to_json(F.col("rows")[0]).alias("text"))
    texts = listed.union(nested).union(single)
    rows = texts.select(F.inline(S.report_rows(F.col("text"), "struct<l_returnflag:string,l_quantity:double>")))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("i07_sharded_inventory", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def i07(spark, sf):
    """Shards listed by a manifest, the row count verified."""
    path = S.write_shards(table(spark, sf, "customer"), scratch_path(spark, "shards"), 4, "c_custkey")
    rows = S.read_shards(spark, path, "c_custkey long, c_mktsegment string")
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query(
    "i08_daily_extremes",
    "SELECT l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS day, CAST(max(CASE WHEN l_quantity > 3 THEN l_quantity / 10 END) AS DOUBLE) AS daily_max FROM lineitem GROUP BY ALL",
)
def i08(spark, sf):
    """Quoted CSV feed with blanks and tenths of a degree."""
    path = scratch_path(spark, "feed")
    li = table(spark, sf, "lineitem")
    tenths = F.when(F.col("l_quantity") > 3, F.col("l_quantity").cast("int").cast("string")).otherwise("  ")
    li.select(F.date_format("l_shipdate", "yyyyMMdd").alias("TM"), F.col("l_suppkey").alias("STN_ID"), tenths.alias("TMP_MAX")).write.option(
        "header", True
    ).option("quoteAll", True).csv(path)
    feed = spark.read.option("header", True).schema("TM string, STN_ID long, TMP_MAX string").csv(path)
    out = P.daily_extremes(feed)
    return out.groupBy(F.col("STN_ID").alias("l_suppkey"), day("observed_date").alias("day")).agg(F.max("daily_max").alias("daily_max"))


@query(
    "i09_station_readings",
    """SELECT l_orderkey, strftime(timezone('Asia/Seoul', timezone('UTC', l_shipdate + to_hours(l_linenumber * 3))), '%Y-%m-%d') AS local_date, count(*) AS n, max(l_quantity / 10)::DOUBLE AS daily_max
    FROM lineitem WHERE l_quantity < 49 GROUP BY ALL""",
)
def i09(spark, sf):
    """Hourly station readings by local date, the sentinel dropped."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_quantity")
    # as many tasks as the table is large, so that none gathers more payloads as it grows
    li = li.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), source_bytes(li) // FEED_BYTES), "l_orderkey")

    def reading(r):
        at = F.date_format(F.timestamp_seconds(F.unix_timestamp(r["l_shipdate"]) + r["l_linenumber"] * 10800), "yyyy-MM-dd'T'HH:mm:ss")
        tmp = F.when(r["l_quantity"] < 49, F.concat(F.lit("+"), F.lpad(r["l_quantity"].cast("int").cast("string"), 4, "0"), F.lit(",1"))).otherwise("+9999,9")
        return F.struct(at.alias("DATE"), tmp.alias("TMP"))

    rows = li.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_shipdate", "l_linenumber", "l_quantity")).alias("rows"))
    feed = rows.select("l_orderkey", F.to_json(F.transform("rows", reading)).alias("payload"))
    out = P.station_day_values(feed, "payload", "Asia/Seoul")
    return out.groupBy("l_orderkey", day("local_date").alias("local_date")).agg(F.count("*").alias("n"), F.max("temperature").alias("daily_max"))


@query("i10_monthly_feed", "SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, max(CASE WHEN o_totalprice > 50000 THEN round(o_totalprice / 10000, 1) END) AS daily_max FROM orders GROUP BY ALL")
def i10(spark, sf):
    """Rows of year, month, day and value; unreadable values are null."""
    o = table(spark, sf, "orders")
    value = F.when(F.col("o_totalprice") > 50000, F.round(F.col("o_totalprice") / 10000, 1).cast("string")).otherwise("***")
    d = F.col("o_orderdate")
    row = F.array(F.year(d).cast("string"), F.month(d).cast("string"), F.dayofmonth(d).cast("string"), value)
    junk = F.array(F.lit("2024"), F.lit("13"), F.lit("45"), F.lit("1"))
    feed = o.select("o_custkey", F.to_json(F.struct(F.array(row, junk).alias("data"))).alias("payload"))
    out = P.monthly_values(feed, "payload")
    return out.groupBy("o_custkey", day("observed_date").alias("day")).agg(F.count("*").alias("n"), F.max("daily_max").alias("daily_max"))


@query(
    "i10_nested_feed",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, round(o_totalprice / 10000, 2) AS daily_max FROM orders WHERE o_orderstatus <> 'P'",
)
def i10n(spark, sf):
    """Daily rows inside station rows; payloads with another code are skipped."""
    o = table(spark, sf, "orders")
    dts = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("DataDate"), F.struct(F.round(F.col("o_totalprice") / 10000, 2).alias("Maximum")).alias("AirTemperature"))
    code = F.when(F.col("o_orderstatus") == "P", 500).otherwise(200)
    feed = o.select("o_orderkey", F.to_json(F.struct(code.alias("code"), F.array(F.struct(F.array(dts).alias("dts"))).alias("data"))).alias("payload"))
    return P.nested_daily(feed, "payload").select("o_orderkey", day("observed_date").alias("day"), "daily_max")


@query(
    "i11_page_maximum",
    """SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN CAST(length(url) AS DOUBLE) + 0.5 END AS daily_max, CASE WHEN page_id % 5 = 0 THEN 'Could not parse Wunderground daily max' END AS error FROM pages""",
)
def i11(spark, sf):
    """First stated maximum in whole pages; an empty-data marker is an error."""
    p = table(spark, sf, "pages")
    value = F.concat((F.length("url") + 0.5).cast("string"))
    nested = F.concat(F.lit('<script>{"temperatureMax": {"value": '), value, F.lit("}}</script>"))
    plain = F.concat(F.lit('<script>{"TEMPERATUREMAX":'), value, F.lit(',"temperatureMax": 1}</script>'))
    none = F.lit('<p>No Data Recorded</p>{"temperatureMax":3}')
    kind = F.col("page_id") % 5
    html = F.concat("html", F.when(kind == 0, none).when(kind < 3, nested).otherwise(plain))
    return p.select("page_id", P.page_maximum(html).alias("m")).select("page_id", "m.*")


@query("i11_observations", "SELECT l_orderkey, max(CASE WHEN l_quantity > 5 THEN l_quantity END) AS daily_max FROM lineitem GROUP BY 1")
def i11o(spark, sf):
    """Greatest readable temperature of an observation list."""
    temp = F.when(F.col("l_quantity") > 5, F.col("l_quantity").cast("string")).otherwise("n/a")
    feed = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.to_json(F.struct(F.collect_list(F.struct(temp.alias("temp"))).alias("observations"))).alias("payload")
    )
    return feed.select("l_orderkey", P.observations_maximum(F.col("payload")).alias("daily_max"))


@query(
    "i12_aviation_reports",
    """SELECT event_id, CASE WHEN event_type <> 'view' THEN 'K' || user_id END AS station_id, CASE event_type WHEN 'error' THEN 0 ELSE CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) END AS observed_s, CASE WHEN event_type <> 'signup' THEN value END AS temp_c FROM events""",
)
def i12(spark, sf):
    """Alternate field names, epoch or ISO times, unreadable times."""
    e = table(spark, sf, "events")
    t = F.col("event_type")
    station = F.concat(F.lit("K"), F.col("user_id").cast("string"))
    payload = F.to_json(
        F.struct(
            F.when(t == "click", station).alias("icaoId"),
            F.when(~t.isin("click", "view"), station).alias("stationId"),
            F.when(t != "signup", F.col("value").cast("string")).otherwise("M").alias("temp"),
            F.when(t == "click", F.unix_timestamp("ts").cast("string")).alias("obsTime"),
            F.when(t == "error", F.lit("garbled")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("reportTime"),
        )
    )
    out = e.select("event_id", P.aviation_report(payload, F.timestamp_seconds(F.lit(0))).alias("m"))
    return out.select("event_id", "m.station_id", F.unix_timestamp("m.observed_at").alias("observed_s"), "m.temp_c")


@query(
    "i13_price_history",
    "SELECT l_orderkey, count(*) AS ticks, CAST(epoch(min(l_shipdate)) AS BIGINT) AS first_s, round(sum(l_discount), 6) AS total FROM lineitem WHERE l_quantity >= 3 GROUP BY 1",
)
def i13(spark, sf):
    """Ticks of price-history payloads; unreadable points are dropped."""
    p = F.when(F.col("l_quantity") >= 3, F.col("l_discount").cast("string")).otherwise("bad")
    feed = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.to_json(F.struct(F.collect_list(F.struct(F.unix_timestamp("l_shipdate").alias("t"), p.alias("p"))).alias("history"))).alias("payload")
    )
    out = P.price_history(feed, "payload")
    return out.groupBy("l_orderkey").agg(
        F.count("*").alias("ticks"), F.unix_timestamp(F.min("timestamp")).alias("first_s"), F.round(F.sum("price"), 6).alias("total")
    )


@query(
    "i14_hourly_columns",
    "SELECT l_orderkey, count(*) AS hours, sum(l_quantity) AS qty, CASE WHEN count(*) < 4 THEN round(sum(l_discount), 6) END AS disc FROM lineitem GROUP BY 1",
)
def i14(spark, sf):
    """Columnar hourly arrays to rows; arrays of another length are null."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_shipdate", "l_quantity", "l_discount")).alias("h"))
    short = F.when(F.size("h") < 4, F.col("h.l_discount")).otherwise(F.slice("h.l_discount", 1, 2))
    hourly = F.struct(F.transform("h.l_shipdate", lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm")).alias("time"), F.col("h.l_quantity").alias("temperature_2m"), short.alias("cloud_cover"))
    feed = li.select("l_orderkey", F.to_json(F.struct(hourly.alias("hourly"))).alias("payload"))
    out = P.hourly_rows(feed, "payload", ["temperature_2m", "cloud_cover"])
    return out.groupBy("l_orderkey").agg(F.count("*").alias("hours"), F.sum("temperature_2m").alias("qty"), F.round(F.sum("cloud_cover"), 6).alias("disc"))


@query("i15_raw_archive", "SELECT page_id, sha256(html) AS sha256, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM pages")
def i15(spark, sf):
    """Whole payloads archived with their content hash."""
    path = scratch_path(spark, "raw")
    S.archive_payloads(table(spark, sf, "pages"), "html", path, ["page_id"])
    return spark.read.parquet(path).select("page_id", "sha256", F.col("size").cast("bigint").alias("size"))


@query("i15_raw_files", "SELECT 'text' AS kind, count(DISTINCT d.lang) AS files FROM documents d")
def i15f(spark, sf):
    """Catalog of raw files: one folder per language, hashes of the bytes."""
    path = scratch_path(spark, "rawfiles")
    d = table(spark, sf, "documents", ["lang", "text"])
    d.write.partitionBy("lang").text(path)
    files = S.raw_catalog(spark, path)
    folders = files.where(F.length("sha256") == 64).select(F.regexp_extract("path", r"lang=(\w+)", 1).alias("lang")).distinct()
    return folders.agg(F.count("*").alias("files")).select(F.lit("text").alias("kind"), "files")


@query("i16_leaderboard_csv", "SELECT n_name AS model, CAST(count(*) AS VARCHAR) AS rows, CAST(max(c_custkey) AS VARCHAR) AS best FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def i16(spark, sf):
    """CSV sink with columns in name order."""
    path = scratch_path(spark, "board")
    b = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    board = b.groupBy(F.col("n_name").alias("model")).agg(F.count("*").alias("rows"), F.max("c_custkey").alias("best"))
    S.write_leaderboard(board, path)
    return spark.read.option("header", True).csv(path)


@query(
    "i17_intraday_readings",
    "SELECT event_id, CAST(floor(epoch(date_trunc('minute', ts))) AS BIGINT) - 28800 AS observed_s, value AS current, value + 2 AS maximum, round(value - 1.5, 2) AS minimum FROM events",
)
def i17(spark, sf):
    """Fixed-layout readings with a local recording time."""
    e = table(spark, sf, "events")
    head = F.concat(F.lit("Latest readings recorded at "), F.date_format("ts", "H:mm"), F.lit(" Hong Kong Time "), F.date_format("ts", "d MMMM yyyy"))
    other = F.lit("\nKing's Park   19.0  80  20.0 / 18.0\n")
    value = F.col("value")
    line = F.concat(F.lit("HK Observatory   "), value.cast("string"), F.lit("   N/A   "), (value + 2).cast("string"), F.lit(" / "), F.round(value - 1.5, 2).cast("string"))
    out = e.select("event_id", (value + 2).alias("want"), P.station_readings(F.concat(head, other, line), "HK Observatory").alias("r"))
    return out.select("event_id", F.unix_timestamp("r.observed_at").alias("observed_s"), "r.current", "r.maximum", "r.minimum")


@query(
    "i17_clock_times",
    """WITH t AS (SELECT event_id, ts, CAST(json_extract_string(props, '$.k') AS INT) * 29 AS d FROM events)
    SELECT event_id, CASE WHEN d // 100 < 24 AND d % 100 < 60 THEN CAST(epoch(date_trunc('day', ts)) AS BIGINT) + (d // 100) * 3600 + (d % 100) * 60 - 32400 ELSE 0 END AS at_s FROM t""",
)
def i17c(spark, sf):
    """Times as up to four digits of the local day, a fallback for bad ones."""
    digits = (F.get_json_object("props", "$.k").cast("int") * 29).cast("string")
    at = P.clock_time(F.to_date("ts"), F.concat(F.lit('"'), digits, F.lit('"')), "Asia/Seoul", F.timestamp_seconds(F.lit(0)))
    return table(spark, sf, "events").select("event_id", F.unix_timestamp(at).alias("at_s"))


@query(
    "i18_feed_freshness",
    "SELECT o_custkey, strftime(max(CASE WHEN o_totalprice > 100000 THEN o_orderdate END), '%Y-%m-%d') AS latest, CASE WHEN max(CASE WHEN o_totalprice > 100000 THEN o_orderdate END) IS NULL THEN 'unknown' WHEN max(CASE WHEN o_totalprice > 100000 THEN o_orderdate END) >= DATE '2001-01-01' THEN 'ready' ELSE 'lag' END AS status FROM orders GROUP BY 1",
)
def i18(spark, sf):
    o = table(spark, sf, "orders").withColumn("d", F.when(F.col("o_totalprice") > 100000, F.to_date("o_orderdate")))
    out = P.feed_freshness(o, "o_custkey", "d", F.lit("2001-01-01").cast("date"))
    return out.select("o_custkey", day("latest_available_date").alias("latest"), "status")


@query(
    "s03_outcome_lists",
    "SELECT l_orderkey, count(*) AS outcomes, round(sum(l_discount), 6) AS total FROM lineitem WHERE l_quantity >= 5 GROUP BY 1",
)
def s03(spark, sf):
    """Labels and prices kept as JSON texts, unreadable prices dropped."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_linenumber", "l_discount", "l_quantity")).alias("x"))
    labels = F.to_json(F.transform("x", lambda e: F.concat(F.lit(" "), e["l_returnflag"], e["l_linenumber"].cast("string"))))
    prices = F.to_json(F.transform("x", lambda e: F.when(e["l_quantity"] >= 5, e["l_discount"].cast("string")).otherwise("-")))
    out = li.select("l_orderkey", F.inline(P.outcome_prices(labels, prices)))
    return out.groupBy("l_orderkey").agg(F.count("*").alias("outcomes"), F.round(F.sum("price"), 6).alias("total"))


@query(
    "s04_grouped_events",
    """SELECT l_orderkey, CAST(count(*) AS INT) AS outcomes, string_agg(l_linenumber || '°C', ',' ORDER BY l_shipdate, l_linenumber, l_partkey) AS labels, CASE WHEN bool_or(l_quantity < 2) THEN 'malformed_component_market' END AS error FROM lineitem GROUP BY 1""",
)
def s04(spark, sf):
    """Grouped event payloads collapsed to one market each."""
    li = table(spark, sf, "lineitem")
    label = F.concat(F.col("l_linenumber").cast("string"), F.lit("°C"))
    asked = F.concat(F.lit("Will the highest temperature be "), label, F.lit(" on May 1?"))
    price = F.array(F.col("l_discount").cast("string"), F.lit("0.5"))
    m = F.struct(
        "l_shipdate", "l_linenumber", "l_partkey",
        F.when(F.col("l_returnflag") == "A", label).alias("groupItemTitle"),
        asked.alias("question"),
        F.when(F.col("l_quantity") >= 2, price).alias("outcomePrices"),
        F.array(F.col("l_partkey").cast("string"), F.lit("no")).alias("clobTokenIds"),
        F.lit("rules").alias("description"),
    )
    ev = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(m)).alias("markets"))
    payload = F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("id"), F.lit("t").alias("title"), F.col("markets")))
    out = ev.select("l_orderkey", P.grouped_event(payload).alias("g"))
    return out.select("l_orderkey", F.size("g.outcomes").alias("outcomes"), F.array_join("g.outcomes.label", ",").alias("labels"), "g.error")


@query(
    "s04_text_prices",
    """SELECT l_orderkey, CASE WHEN l_orderkey % 4 = 0 THEN 'q' || l_orderkey WHEN l_orderkey % 4 = 1 THEN 'slug-' || l_orderkey WHEN l_orderkey % 4 = 2 THEN 'https://e/' || l_orderkey ELSE 'id' || l_orderkey END AS id,
    CASE WHEN l_orderkey % 3 = 0 THEN 'neg' WHEN l_orderkey % 4 = 0 THEN 'q' || l_orderkey ELSE 'c' || l_orderkey END AS condition_id, round(sum(l_discount) FILTER (l_quantity >= 4), 6) AS prices,
    CASE WHEN bool_or(l_quantity < 4) THEN 'malformed_component_market' WHEN l_orderkey % 5 = 0 THEN 'missing_description' END AS error, CASE WHEN l_orderkey % 5 > 0 THEN 'event rules' END AS description FROM lineitem GROUP BY 1""",
)
def s04t(spark, sf):
    """Prices kept as JSON text or numbers, ids and descriptions from where there are any."""
    o = F.col("l_orderkey")
    key = o.cast("string")
    listed = F.to_json(F.array(F.col("l_discount"), F.lit(0.5)))
    prices = F.when(F.col("l_quantity") < 2, "no list").when(F.col("l_quantity") < 4, "[]").otherwise(listed)
    m = F.struct(
        F.lit("21°C").alias("groupItemTitle"), prices.alias("outcomePrices"), F.array(F.col("l_partkey")).alias("clobTokenIds"),
        F.when(o % 4 == 0, F.concat(F.lit("q"), key)).otherwise("").alias("questionID"), F.concat(F.lit("c"), key).alias("conditionId"), F.lit("").alias("description"),
    )
    ev = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(m).alias("markets"))
    event = F.struct(
        F.when(o % 4 == 3, F.concat(F.lit("id"), key)).otherwise("").alias("id"), F.when(o % 4 == 1, F.concat(F.lit("slug-"), key)).alias("slug"),
        F.when(o % 3 == 0, "neg").alias("negRiskMarketID"), F.when(o % 5 > 0, " event rules ").alias("description"), "markets",
    )
    out = ev.select("l_orderkey", P.grouped_event(F.to_json(event), F.concat(F.lit("https://e/"), key)).alias("g"))
    total = F.aggregate("g.outcomes", F.lit(None).cast("double"), lambda a, c: F.coalesce(a + F.coalesce(c["price"].cast("double"), F.lit(0.0)), c["price"].cast("double"), a))
    return out.select("l_orderkey", "g.id", "g.condition_id", F.round(total, 6).alias("prices"), "g.error", "g.description")


@query(
    "s40_last_trades",
    """SELECT event_id, CASE event_type WHEN 'click' THEN value WHEN 'view' THEN value + 1 WHEN 'error' THEN value + 2 END AS last_trade_price, CASE WHEN event_type <> 'signup' THEN 'BUY' END AS last_trade_side, event_type IN ('click', 'view', 'error') AS last_trade_present FROM events""",
)
def s40(spark, sf):
    """First usable price and side among alternate names."""
    t, v = F.col("event_type"), F.col("value")
    payload = F.to_json(
        F.struct(
            F.when(t == "click", v.cast("string")).when(t == "view", "n/a").alias("price"),
            F.when(t == "view", (v + 1).cast("string")).alias("last_trade_price"),
            F.when(t == "error", (v + 2).cast("string")).alias("lastTradePrice"),
            F.when(t == "click", "BUY").otherwise("").alias("side"),
            F.when(~t.isin("click", "signup"), "BUY").alias("last_trade_side"),
        )
    )
    return table(spark, sf, "events").select("event_id", P.last_trade(payload).alias("x")).select("event_id", "x.*")


@query(
    "s36_book_payloads",
    """WITH r AS (SELECT l_orderkey, l_discount, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_quantity) AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_quantity DESC) AS b FROM lineitem)
    SELECT l_orderkey, min(l_discount) AS best_ask, max(l_discount) AS best_bid, round(sum(l_quantity) FILTER (a <= 5) + sum(l_quantity) FILTER (b <= 5), 6) AS liquidity FROM r GROUP BY 1""",
)
def s36p(spark, sf):
    """Books from payloads: sorted, five levels deep."""
    from skyledger.operators import trade as X

    lv = F.struct(F.col("l_discount").cast("string").alias("price"), F.col("l_quantity").cast("string").alias("size"))
    books = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(lv).alias("l"))
    payload = F.to_json(F.struct(F.col("l").alias("bids"), F.col("l").alias("asks"), F.lit("1700000000000").alias("timestamp")))
    b = books.select("l_orderkey", P.book_payload(payload).alias("b"))
    return b.select(
        "l_orderkey",
        X.best_ask(F.col("b.asks")).alias("best_ask"),
        X.best_bid(F.col("b.bids")).alias("best_bid"),
        F.round(X.visible_liquidity(F.col("b.bids"), F.col("b.asks")), 6).alias("liquidity"),
    )
