"""The given tables in the roles of the market product.

Each role is a Spark function plus the same definition as a SQL common table
expression, so a query and its reference statement start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.sources.tables import table

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

CTES = {
    "cities": """cities AS (SELECT c.c_custkey, n.n_name AS city, r.r_name AS country, n.n_nationkey AS nationkey
        FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)""",
    "ticks": """ticks AS (SELECT CAST(user_id AS VARCHAR) AS market_id, event_type AS token_id, ts AS tick_ts,
        CASE WHEN value >= 5 THEN value END AS price, event_id AS seq FROM events)""",
    "decisions": """decisions AS (SELECT CAST(e.user_id AS VARCHAR) AS market_id, c.city, e.event_id AS decision_id,
        e.ts AS decision_ts, CASE WHEN hour(e.ts) < 6 THEN 'morning_of' WHEN hour(e.ts) < 12 THEN 'market_open'
        ELSE 'previous_evening' END AS decision_horizon, t.token_id
        FROM events e LEFT JOIN cities c ON c.c_custkey = e.user_id
        CROSS JOIN (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) t(token_id))""",
    "panel": """panel AS (SELECT d.*, CASE WHEN t.price IS NOT NULL THEN t.price END AS market_price,
        CASE WHEN t.price IS NOT NULL THEN epoch_us(d.decision_ts) - epoch_us(t.tick_ts) END / 1e6 AS price_age_seconds,
        CASE WHEN t.price IS NULL THEN 'missing'
             WHEN (epoch_us(d.decision_ts) - epoch_us(t.tick_ts)) / 1e6 <= 43200 THEN 'ok' ELSE 'stale' END AS coverage_status
        FROM decisions d ASOF LEFT JOIN ticks t
        ON d.market_id = t.market_id AND d.token_id = t.token_id AND d.decision_ts >= t.tick_ts)""",
    "trades": """trades AS (SELECT l_orderkey AS market_id, l_linenumber AS line, c.city, c.country,
        o_orderpriority AS decision_horizon, l_returnflag AS outcome_label,
        CASE WHEN l_linestatus = 'F' THEN 'R' ELSE 'A' END AS winning_outcome,
        round(0.05 + l_discount * 9, 2) AS price, l_quantity AS size, round(l_discount - l_tax, 4) AS edge,
        CAST(date_diff('day', o_orderdate, l_shipdate) AS DOUBLE) * 600 AS price_age_seconds,
        CAST(o_orderdate AS DATE) AS target_date,
        round(CASE WHEN l_returnflag = CASE WHEN l_linestatus = 'F' THEN 'R' ELSE 'A' END
              THEN l_quantity * (1 - round(0.05 + l_discount * 9, 2)) ELSE -l_quantity * round(0.05 + l_discount * 9, 2) END, 4) AS realized_pnl
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN cities c ON o_custkey = c.c_custkey)""",
    "hourly": """hourly AS (SELECT CAST(l_suppkey AS VARCHAR) AS market_id, l_returnflag AS model_name,
        CASE o_orderstatus WHEN 'F' THEN 'single_run' WHEN 'O' THEN 'historical_forecast' ELSE 'fixture' END AS endpoint_kind,
        CASE WHEN o_orderstatus = 'F' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'market_open'
             WHEN '2-HIGH' THEN 'previous_evening' ELSE 'morning_of' END END AS decision_horizon,
        l_shipdate AS forecast_ts, CAST(date_trunc('month', l_shipdate) AS DATE) AS local_date,
        CAST(date_trunc('month', o_orderdate) AS DATE) AS target_local_date, l_linenumber * 3 AS hour,
        CASE WHEN l_quantity > 2 THEN l_discount * 100 + l_tax * 50 END AS temperature_2m,
        l_extendedprice / 5000 AS dew_point_2m, l_discount * 1000 AS relative_humidity_2m,
        l_tax * 100 AS wind_speed_10m, l_quantity * 2 AS cloud_cover,
        CASE WHEN l_linenumber > 1 THEN o_orderdate END AS issue_time_utc, l_orderkey, l_linenumber
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "preds": """preds AS (SELECT l_orderkey AS market_id, l_linenumber AS line, n_name AS city, r_name AS country,
        o_orderpriority AS decision_horizon, CAST(l_shipdate AS DATE) AS target_date, l_returnflag AS model_name,
        l_quantity AS mean, 1 + l_tax * 50 AS std, l_quantity + (l_discount - l_tax) * 100 AS y,
        CASE WHEN l_linestatus = 'F' THEN 'F' ELSE 'C' END AS unit
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "opportunities": """opportunities AS (SELECT event_id, date_trunc('hour', ts) AS observed_at, ts,
        CAST(user_id AS VARCHAR) AS market_id, c.city, CASE WHEN hour(ts) < 6 THEN 'morning_of'
        WHEN hour(ts) < 12 THEN 'market_open' ELSE 'previous_evening' END AS decision_horizon,
        CASE event_type WHEN 'click' THEN 'tradable' WHEN 'view' THEN 'raw_gap_non_positive'
             WHEN 'purchase' THEN 'fee_killed_edge' WHEN 'signup' THEN 'after_cost_positive_but_spread_too_wide'
             ELSE 'missing_book' END AS reason,
        round((value - 20) / 100, 4) AS raw_gap, round((value - 21) / 100, 4) AS edge_after_fee,
        CASE WHEN event_type <> 'error' THEN round((value - 22) / 100, 4) END AS after_cost_edge,
        round(value / 400, 6) AS spread, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
        FROM events LEFT JOIN cities c ON c.c_custkey = user_id)""",
}
NEEDS = {
    "decisions": ["cities"],
    "panel": ["ticks", "decisions"],
    "trades": ["cities"],
    "opportunities": ["cities"],
}


def with_roles(names: str, body: str) -> str:
    """``body`` preceded by the common table expressions of the named roles."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        add(name)
    body = body.strip()
    head = "WITH " + ",\n".join(CTES[n] for n in wanted)
    return f"{head}, {body[5:]}" if body[:5].upper() == "WITH " else f"{head}\n{body}"


def horizon_of(ts) -> F.Column:
    return (
        F.when(F.hour(ts) < 6, "morning_of").when(F.hour(ts) < 12, "market_open").otherwise("previous_evening")
    )


def cities(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("n_name").alias("city"), F.col("r_name").alias("country"), F.col("n_nationkey").alias("nationkey")
    )


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("market_id"),
        F.col("event_type").alias("token_id"),
        F.col("ts").alias("tick_ts"),
        F.when(F.col("value") >= 5, F.col("value")).alias("price"),
        F.col("event_id").alias("seq"),
    )


def decision_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions with their outcome labels and tokens as lists."""
    tokens = F.array(*[F.lit(t) for t in EVENT_TYPES])
    return (
        table(spark, sf, "events")
        .join(cities(spark, sf), F.col("c_custkey") == F.col("user_id"), "left")
        .select(
            F.col("user_id").cast("string").alias("market_id"),
            "city",
            F.col("event_id").alias("decision_id"),
            F.col("ts").alias("decision_ts"),
            horizon_of(F.col("ts")).alias("decision_horizon"),
            F.transform(tokens, lambda t: F.upper(t)).alias("labels"),
            tokens.alias("tokens"),
        )
    )


def panel(spark: SparkSession, sf: str) -> DataFrame:
    from skyledger.operators.asof import decision_tokens, price_panel

    decisions = decision_tokens(decision_lists(spark, sf), "labels", "tokens")
    return price_panel(
        decisions, ticks(spark, sf), ["market_id", "token_id"], "decision_ts", "tick_ts", "price", 720.0, sequence="seq"
    )


def trades(spark: SparkSession, sf: str) -> DataFrame:
    price = F.round(0.05 + F.col("l_discount") * 9, 2)
    winner = F.when(F.col("l_linestatus") == "F", "R").otherwise("A")
    # the cities meet the orders, which are fewer and narrower than their lines
    orders = table(spark, sf, "orders").join(cities(spark, sf), F.col("o_custkey") == F.col("c_custkey"), "left")
    return (
        table(spark, sf, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_orderkey").alias("market_id"),
            F.col("l_linenumber").alias("line"),
            "city",
            "country",
            F.col("o_orderpriority").alias("decision_horizon"),
            F.col("l_returnflag").alias("outcome_label"),
            winner.alias("winning_outcome"),
            price.alias("price"),
            F.col("l_quantity").alias("size"),
            F.round(F.col("l_discount") - F.col("l_tax"), 4).alias("edge"),
            (F.datediff("l_shipdate", "o_orderdate").cast("double") * 600).alias("price_age_seconds"),
            F.to_date("o_orderdate").alias("target_date"),
            F.round(
                F.when(F.col("l_returnflag") == winner, F.col("l_quantity") * (1 - price)).otherwise(
                    -F.col("l_quantity") * price
                ),
                4,
            ).alias("realized_pnl"),
        )
    )


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    horizon = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "market_open")
        .when(F.col("o_orderpriority") == "2-HIGH", "previous_evening")
        .otherwise("morning_of")
    )
    return (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_suppkey").cast("string").alias("market_id"),
            F.col("l_returnflag").alias("model_name"),
            F.when(F.col("o_orderstatus") == "F", "single_run")
            .when(F.col("o_orderstatus") == "O", "historical_forecast")
            .otherwise("fixture")
            .alias("endpoint_kind"),
            F.when(F.col("o_orderstatus") == "F", horizon).alias("decision_horizon"),
            F.col("l_shipdate").alias("forecast_ts"),
            F.trunc("l_shipdate", "month").alias("local_date"),
            F.trunc("o_orderdate", "month").alias("target_local_date"),
            (F.col("l_linenumber") * 3).alias("hour"),
            F.when(F.col("l_quantity") > 2, F.col("l_discount") * 100 + F.col("l_tax") * 50).alias("temperature_2m"),
            (F.col("l_extendedprice") / 5000).alias("dew_point_2m"),
            (F.col("l_discount") * 1000).alias("relative_humidity_2m"),
            (F.col("l_tax") * 100).alias("wind_speed_10m"),
            (F.col("l_quantity") * 2).alias("cloud_cover"),
            F.when(F.col("l_linenumber") > 1, F.col("o_orderdate")).alias("issue_time_utc"),
            "l_orderkey",
            "l_linenumber",
        )
    )


def preds(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("l_orderkey").alias("market_id"),
            F.col("l_linenumber").alias("line"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("country"),
            F.col("o_orderpriority").alias("decision_horizon"),
            F.to_date("l_shipdate").alias("target_date"),
            F.col("l_returnflag").alias("model_name"),
            F.col("l_quantity").alias("mean"),
            (1 + F.col("l_tax") * 50).alias("std"),
            (F.col("l_quantity") + (F.col("l_discount") - F.col("l_tax")) * 100).alias("y"),
            F.when(F.col("l_linestatus") == "F", "F").otherwise("C").alias("unit"),
        )
    )


def opportunities(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("value")
    reason = (
        F.when(F.col("event_type") == "click", "tradable")
        .when(F.col("event_type") == "view", "raw_gap_non_positive")
        .when(F.col("event_type") == "purchase", "fee_killed_edge")
        .when(F.col("event_type") == "signup", "after_cost_positive_but_spread_too_wide")
        .otherwise("missing_book")
    )
    return (
        table(spark, sf, "events")
        .join(cities(spark, sf), F.col("c_custkey") == F.col("user_id"), "left")
        .select(
            "event_id",
            F.date_trunc("hour", "ts").alias("observed_at"),
            "ts",
            F.col("user_id").cast("string").alias("market_id"),
            "city",
            horizon_of(F.col("ts")).alias("decision_horizon"),
            reason.alias("reason"),
            F.round((value - 20) / 100, 4).alias("raw_gap"),
            F.round((value - 21) / 100, 4).alias("edge_after_fee"),
            F.when(F.col("event_type") != "error", F.round((value - 22) / 100, 4)).alias("after_cost_edge"),
            F.round(value / 400, 6).alias("spread"),
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        )
    )
