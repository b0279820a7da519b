"""Streaming jobs run to completion over the given tables; results equal the batch ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import reports as R
from skyledger.operators.asof import source_bytes
from skyledger.plans import roles
from skyledger.plans.q_reports import LEVELS, log_sql
from skyledger.plans.registry import query
from skyledger.plans.roles import with_roles
from skyledger.session import scratch_path
from skyledger.sources.tables import table, utc_timestamps
from skyledger.streaming import jobs as J


#: Bytes of the tables behind landed rows for each of their files; there are 4 at least.
FILE_BYTES = 1 << 23


def landed(spark, sf, rows):
    """Rows landed as files of a folder, more of them from larger tables, from where a stream reads them in two batches."""
    path = scratch_path(spark, "landed")
    half = max(2, source_bytes(rows) // (2 * FILE_BYTES))
    rows.repartition(2 * half).write.parquet(path)
    return J.read_files(spark, path, rows.schema, files_per_batch=half)


def in_two_runs(spark, rows, second, run):
    """``run(stream)`` twice: rows without ``second`` land first, the rest before the second run."""
    path = scratch_path(spark, "landed")
    for part in (rows.where(~second), rows.where(second)):
        part.write.mode("append").parquet(path)
        out = run(J.read_files(spark, path, rows.schema))
    return out


def event_stream(spark, sf, files_per_batch=None):
    """The events table as a stream."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return utc_timestamps(J.read_files(spark, sf, schema, "events.parquet", files_per_batch))


def result(spark, frame):
    """Run a streaming frame to the end into a table and read it."""
    path = scratch_path(spark, "out")
    J.run_available(frame.writeStream.format("parquet").outputMode("append").option("path", path), scratch_path(spark, "ckpt"))
    return spark.read.schema(frame.schema).parquet(path)


#: Rows of the second run in queries that run a job twice.
SECOND = "event_id % 10 = 0"


@query("t01_append_log", "SELECT strftime(ts, '%Y-%m-%d') AS dt, event_type, count(*) AS n FROM events GROUP BY ALL")
def t01(spark, sf):
    """Stream appended to a table partitioned by day."""
    path = scratch_path(spark, "log")
    J.append_partitioned(event_stream(spark, sf), path, "ts")
    out = spark.read.schema("event_id long, event_type string, dt string").parquet(path)
    return out.groupBy("dt", "event_type").agg(F.count("*").alias("n"))


@query(
    "t02_running_summary",
    with_roles(
        "opportunities",
        "SELECT city, count(*) AS markets_evaluated, count(*) FILTER (reason = 'tradable') AS tradable_count, count(*) FILTER (after_cost_edge > 0) AS positive, max(raw_gap) AS best_raw_gap FROM opportunities GROUP BY 1",
    ),
)
def t02(spark, sf):
    """Log summary kept up to date over several micro-batches and two runs."""
    rows, path = roles.opportunities(spark, sf), scratch_path(spark, "summary")
    partial = [
        F.count("*").alias("markets_evaluated"),
        R.count_if(F.col("reason") == "tradable").alias("tradable_count"),
        R.count_if(F.col("after_cost_edge") > 0).alias("positive"),
        F.max("raw_gap").alias("best_raw_gap"),
    ]
    merged = [F.sum(n).alias(n) for n in ("markets_evaluated", "tradable_count", "positive")] + [F.max("best_raw_gap").alias("best_raw_gap")]
    return in_two_runs(spark, rows, F.expr(SECOND), lambda stream: J.running_summary(stream, ["city"], partial, merged, path)).read()


@query("t02_batch_report", log_sql(", round(median(spread), 8) AS median_spread"))
def t02b(spark, sf):
    """Full report with medians over the table a stream appends to."""
    path = scratch_path(spark, "log")
    stream = landed(spark, sf, roles.opportunities(spark, sf))
    J.append_partitioned(stream, path, "ts")
    log = spark.read.schema(stream.schema).parquet(path)
    out = R.log_summary(log, LEVELS, {"spread": "median_spread"})
    return out.withColumn("median_spread", F.round("median_spread", 8))


LATE_SQL = f"""WITH f AS (SELECT max(ts) AS seen FROM opportunities WHERE NOT ({SECOND})), o AS (SELECT *, {SECOND} AND WINDOW_END <= (SELECT seen FROM f) - INTERVAL 9 DAY AS late FROM opportunities)"""


@query(
    "t03_cycle_summary",
    with_roles(
        "opportunities",
        LATE_SQL.replace("WINDOW_END", "observed_at + INTERVAL 1 HOUR")
        + """ SELECT epoch_us(observed_at) AS cycle_us, count(*) FILTER (NOT late) AS markets_evaluated, count(*) FILTER (reason = 'tradable' AND NOT late) AS tradable_count,
    max(raw_gap) FILTER (NOT late) AS best_raw_gap, count(*) FILTER (late) AS late_rows FROM o GROUP BY 1""",
    ),
)
def t03(spark, sf):
    """Hourly cycles in tumbling windows; a tenth of the rows comes in a second run, those nine days late only count."""
    path = scratch_path(spark, "cycles")
    table_ = in_two_runs(spark, roles.opportunities(spark, sf), F.expr(SECOND), lambda s: J.cycle_summary(s, "ts", "1 hour", "9 days", path))
    return table_.read().select(F.unix_micros("start").alias("cycle_us"), "markets_evaluated", "tradable_count", "best_raw_gap", "late_rows")


@query("t04_distinct_events", "SELECT user_id, event_type, CAST(props AS VARCHAR) AS props FROM events GROUP BY ALL")
def t04(spark, sf):
    """Repeated keys dropped within the watermark."""
    e = event_stream(spark, sf).select("user_id", "event_type", "props", "ts")
    out = result(spark, J.first_per_key(e, ["user_id", "event_type", "props"], "ts", "60 days"))
    return out.select("user_id", "event_type", "props")


T5_SQL = """WITH t AS (SELECT user_id || ':' || event_type AS position, ts, event_id, value, first_value(value) OVER w AS entry, max(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS seen
    FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
  s AS (SELECT *, CASE WHEN entry > 0 AND (entry - value) / entry >= 0.2 THEN 'stop_loss' WHEN seen > entry AND (seen - value) / seen >= 0.2 THEN 'trailing_stop' END AS reason FROM t)
  SELECT position, epoch_us(min(ts)) AS exit_us, arg_min(reason, (ts, event_id)) AS exit_reason, arg_min(value, (ts, event_id)) AS exit_price, arg_min(seen, (ts, event_id)) AS high_water_mark FROM s WHERE reason IS NOT NULL GROUP BY 1"""


@query("t05_stop_alerts", T5_SQL)
def t05(spark, sf):
    """Stop and trailing-stop alerts with state per position, over files in time order."""
    e = table(spark, sf, "events").select(
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("position"),
        "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"),
    )
    landing, path = scratch_path(spark, "ticks"), scratch_path(spark, "stops")
    middle = F.lit("2024-01-15").cast("timestamp")
    for part in (e.where(F.col("ts") < middle), e.where(F.col("ts") >= middle)):
        part.write.mode("append").parquet(landing)
        J.stop_alerts(J.read_files(spark, landing, e.schema), "position", "ts", "price", "seq", path)
    out = spark.read.parquet(f"{path}/alerts")
    return out.select("position", F.unix_micros("exit_time").alias("exit_us"), "exit_reason", "exit_price", "high_water_mark")


@query(
    "t06_watch_matches",
    "SELECT event_id, round(c_acctbal / 1000 - value, 6) AS gap FROM events JOIN customer ON c_custkey = user_id WHERE value <= c_acctbal / 1000",
)
def t06(spark, sf):
    """Asks that reach a rule's threshold, stream against the rule table."""
    rules = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") / 1000).alias("threshold"))
    e = event_stream(spark, sf).select("event_id", "user_id", F.col("value").alias("best_ask"))
    out = result(spark, J.watch_matches(e, rules, ["user_id"]))
    return out.select("event_id", F.round("gap", 6).alias("gap"))


@query(
    "t07_stream_freshness",
    "SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) <= 40 AS fresh, count(*) AS n FROM events GROUP BY ALL",
)
def t07s(spark, sf):
    """Rows already old when received."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = event_stream(spark, sf).withColumn("received", F.timestamp_micros(F.unix_micros("ts") + k * 60_000_000))
    out = result(spark, J.freshness_flags(e.select("event_type", "ts", "received"), "ts", "received", 40.0))
    return out.groupBy("event_type", "fresh").agg(F.count("*").alias("n"))


@query(
    "t08_latest_prices",
    with_roles("ticks", "SELECT market_id, token_id, arg_max(price, tick_ts) AS price, epoch_us(max(tick_ts)) AS tick_us FROM ticks WHERE price IS NOT NULL GROUP BY ALL"),
)
def t08(spark, sf):
    """Latest price per token over two runs."""
    path = scratch_path(spark, "latest")
    out = in_two_runs(spark, roles.ticks(spark, sf), F.expr("seq % 10 = 0"), lambda s: J.latest_price(s, ["market_id", "token_id"], "tick_ts", "price", path))
    return out.read().select("market_id", "token_id", "latest.price", F.unix_micros("latest.tick_ts").alias("tick_us"))


@query(
    "t09_l2_windows",
    with_roles(
        "opportunities",
        LATE_SQL.replace("WINDOW_END", "date_trunc('day', ts) + INTERVAL 1 DAY")
        + """, m AS (SELECT date_trunc('day', ts) AS start, CASE WHEN k <= 24 THEN '0-24h' WHEN k <= 48 THEN '24-48h' ELSE '48h+' END AS bucket, late, raw_gap, spread FROM o),
    a AS (SELECT start, bucket, count(*) FILTER (NOT late) AS count, round(avg(raw_gap) FILTER (NOT late), 11) AS mean_bid_depth, round(avg(CAST(spread < 0.1 AS INT)) FILTER (NOT late) * 100, 6) AS tradeable_pct,
      list_sort(list(spread) FILTER (NOT late)) AS spreads, count(*) FILTER (late) AS late_rows FROM m GROUP BY ALL), v AS (SELECT *, spreads[len(spreads) // 2 + 1] AS v FROM a)
    SELECT epoch_us(start) AS start_us, bucket, count, mean_bid_depth, tradeable_pct, round(CASE WHEN v = 0 THEN 0 ELSE sign(v) * power(2, (floor((log2(abs(v)) + 1100) * 128) + 0.5) / 128 - 1100) END, 6) AS median_spread, late_rows FROM v""",
    ),
)
def t09(spark, sf):
    """Depth and median spread per day and settlement bucket; rows of a second run that are nine days late only count."""
    rows = roles.opportunities(spark, sf).withColumnRenamed("raw_gap", "bid_depth")
    bucket = F.when(F.col("k") <= 24, "0-24h").when(F.col("k") <= 48, "24-48h").otherwise("48h+")
    path = scratch_path(spark, "l2")
    out = J.l2_summary(in_two_runs(spark, rows, F.expr(SECOND), lambda s: J.l2_windows(s, "ts", "1 day", "9 days", bucket, path)).read())
    return out.select(
        F.unix_micros("start").alias("start_us"), "bucket", "count", F.round("mean_bid_depth", 11).alias("mean_bid_depth"),
        F.round("tradeable_pct", 6).alias("tradeable_pct"), F.round("median_spread", 6).alias("median_spread"), "late_rows",
    )


@query(
    "t11_live_panel",
    with_roles("panel", "SELECT coverage_status, decision_horizon, count(*) AS n, round(sum(market_price), 2) AS total FROM panel GROUP BY ALL"),
)
def t11(spark, sf):
    """Decisions priced as they arrive."""
    from skyledger.operators.asof import decision_tokens

    stream = landed(spark, sf, decision_tokens(roles.decision_lists(spark, sf), "labels", "tokens"))
    path = scratch_path(spark, "live")
    J.live_panel(
        stream, roles.ticks(spark, sf), ["market_id", "token_id"], path,
        decision_time="decision_ts", tick_time="tick_ts", price="price", max_age_minutes=720.0, sequence="seq",
    )
    panel = spark.read.parquet(path)
    return panel.groupBy("coverage_status", "decision_horizon").agg(F.count("*").alias("n"), F.round(F.sum("market_price"), 2).alias("total"))
