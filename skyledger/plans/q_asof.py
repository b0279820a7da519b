"""As-of panel, latest-row and stop queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import asof
from skyledger.plans import roles
from skyledger.plans.registry import query
from skyledger.plans.roles import with_roles
from skyledger.sources.tables import table


@query(
    "j02_asof_panel",
    with_roles(
        "panel",
        """SELECT decision_id, market_id, token_id, upper(token_id) AS outcome_label, decision_horizon, coverage_status,
        round(market_price, 4) AS market_price, round(price_age_seconds, 6) AS price_age_seconds FROM panel""",
    ),
)
def j02(spark, sf):
    """Every decision and token with its latest admissible price."""
    return roles.panel(spark, sf).select(
        "decision_id",
        "market_id",
        "token_id",
        "outcome_label",
        "decision_horizon",
        "coverage_status",
        F.round("market_price", 4).alias("market_price"),
        F.round("price_age_seconds", 6).alias("price_age_seconds"),
    )


@query(
    "a07_panel_coverage",
    with_roles(
        "panel",
        """SELECT city, decision_horizon, coverage_status, count(*) AS token_count,
        count(DISTINCT market_id) AS market_count FROM panel GROUP BY ALL""",
    ),
)
def a07(spark, sf):
    """Share of tokens with a fresh enough price, by city and horizon."""
    from skyledger.operators.reports import panel_summary

    return panel_summary(roles.panel(spark, sf))


@query(
    "a07_market_summary",
    with_roles(
        "panel",
        """SELECT city, market_id, decision_horizon, count(*) AS token_count,
        count(*) FILTER (coverage_status = 'ok') AS ok_token_count,
        count(*) FILTER (coverage_status = 'stale') AS stale_token_count,
        count(*) FILTER (coverage_status = 'missing') AS missing_token_count,
        count(*) FILTER (coverage_status = 'ok') > 0 AS market_ready FROM panel GROUP BY ALL""",
    ),
)
def a07m(spark, sf):
    from skyledger.operators.reports import market_summary

    return market_summary(roles.panel(spark, sf))


@query(
    "j03_latest_before",
    """WITH e AS (SELECT *, date_trunc('day', ts) AS day FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:00:00')
    SELECT event_id, user_id, event_type FROM e WHERE day = (SELECT max(day) FROM e)""",
)
def j03(spark, sf):
    """All rows sharing the latest snapshot time at or before a moment."""
    e = table(spark, sf, "events").where(F.col("ts") <= F.lit("2024-01-20 12:00:00").cast("timestamp"))
    e = e.withColumn("day", F.date_trunc("day", "ts"))
    at = F.lit("2024-01-20 12:00:00").cast("timestamp")
    return asof.latest_before(e, "day", at).select("event_id", "user_id", "event_type")


@query(
    "j03_latest_before_per_key",
    """WITH o AS (SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '1999-06-30')
    SELECT o_orderkey, o_custkey, o_orderstatus FROM o
    QUALIFY o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey)""",
)
def j03k(spark, sf):
    at = F.lit("1999-06-30").cast("timestamp")
    return asof.latest_before_per_key(table(spark, sf, "orders"), ["o_custkey"], "o_orderdate", at).select(
        "o_orderkey", "o_custkey", "o_orderstatus"
    )


@query(
    "w03_last_price",
    with_roles(
        "ticks",
        """SELECT market_id, token_id, round(arg_max(price, tick_ts), 4) AS price, epoch_us(max(tick_ts)) AS price_us
        FROM ticks WHERE price IS NOT NULL GROUP BY ALL""",
    ),
)
def w03(spark, sf):
    out = asof.last_value(roles.ticks(spark, sf), ["market_id", "token_id"], "price", "tick_ts", ["seq"])
    return out.select("market_id", "token_id", F.round("price", 4).alias("price"), F.unix_micros("tick_ts").alias("price_us"))


@query(
    "a42_market_implied",
    with_roles(
        "ticks",
        """, last AS (SELECT market_id, token_id, arg_max(price, tick_ts) AS p FROM ticks WHERE price IS NOT NULL GROUP BY ALL)
        SELECT market_id, token_id, round(p / sum(p) OVER (PARTITION BY market_id), 6) AS prob FROM last""".replace(", last", "WITH last", 1),
    ),
)
def a42(spark, sf):
    """Market-implied distribution from the last price of every outcome."""
    from skyledger.operators.scoring import implied_distribution

    out = implied_distribution(roles.ticks(spark, sf), ["market_id"], "token_id", "price", "tick_ts", ["seq"])
    return out.select("market_id", "token_id", F.round("prob", 6).alias("prob"))


STOP_SQL = """WITH t AS (SELECT user_id, event_type, ts, event_id, value, first_value(value) OVER w AS entry,
      max(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS seen
    FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
  s AS (SELECT *, CASE WHEN entry > 0 AND (entry - value) / entry >= 0.2 THEN 'stop_loss'
      WHEN greatest(seen, entry) > entry AND (greatest(seen, entry) - value) / greatest(seen, entry) >= 0.2 THEN 'trailing_stop' END AS reason FROM t)
  SELECT user_id, event_type, epoch_us(min(ts)) AS exit_us, arg_min(reason, (ts, event_id)) AS exit_reason,
    round(arg_min(value, (ts, event_id)), 4) AS exit_price, round(arg_min(greatest(seen, entry), (ts, event_id)), 4) AS high_water_mark
  FROM s WHERE reason IS NOT NULL GROUP BY ALL"""


@query("w10_stop_scan", STOP_SQL)
def w10(spark, sf):
    """First stop per position; the entry price is the first trade of the position."""
    e = table(spark, sf, "events")
    entry = e.groupBy("user_id", "event_type").agg(F.min_by("value", F.struct("ts", "event_id")).alias("entry"))
    ticks = e.select("user_id", "event_type", "ts", "event_id", "value").join(entry, ["user_id", "event_type"])
    out = asof.stop_scan(ticks, ["user_id", "event_type"], "ts", "value", "entry", 0.20, ["event_id"])
    return out.select(
        "user_id",
        "event_type",
        F.unix_micros("exit_time").alias("exit_us"),
        "exit_reason",
        F.round("exit_price", 4).alias("exit_price"),
        F.round("high_water_mark", 4).alias("high_water_mark"),
    )
