"""Coverage, log, trade and error reports over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import reports as R
from skyledger.plans import roles
from skyledger.plans.registry import query
from skyledger.plans.roles import with_roles
from skyledger.session import written
from skyledger.sources.tables import table


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- truth, readiness, requests ------------------------------------------------

TRUTH = """truth AS (SELECT CAST(o_custkey AS VARCHAR) AS market_id, c.city, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'lag'
    ELSE 'error' END AS status, c.country AS truth_track, o_orderpriority AS source, o_orderdate AS fetched_at, o_orderkey,
    CAST(o_orderdate AS DATE) AS target_local_date, CASE WHEN o_totalprice > 20000 THEN CAST(o_orderdate AS DATE) - CAST(floor(o_totalprice / 100000) AS INT) END AS latest_available_date
    FROM orders LEFT JOIN cities c ON o_custkey = c.c_custkey)"""


def truth(spark, sf):
    back = F.floor(F.col("o_totalprice") / 100000).cast("int")
    return (
        table(spark, sf, "orders")
        .join(roles.cities(spark, sf), F.col("o_custkey") == F.col("c_custkey"), "left")
        .select(
            F.col("o_custkey").cast("string").alias("market_id"),
            "city",
            F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "lag").otherwise("error").alias("status"),
            F.col("country").alias("truth_track"),
            F.col("o_orderpriority").alias("source"),
            F.col("o_orderdate").alias("fetched_at"),
            "o_orderkey",
            F.to_date("o_orderdate").alias("target_local_date"),
            F.when(F.col("o_totalprice") > 20000, F.date_sub(F.to_date("o_orderdate"), back)).alias("latest_available_date"),
        )
    )


def with_truth(body):
    return with_roles("cities", f"WITH {TRUTH} {body}")


@query("a04_truth_coverage", with_truth("SELECT status, truth_track, city, source, count(*) AS count FROM truth GROUP BY ALL"))
def a04(spark, sf):
    return R.truth_coverage(truth(spark, sf), ["status", "truth_track", "city", "source"])


@query(
    "a04_truth_lag_days",
    with_truth("SELECT o_orderkey, status, date_diff('day', latest_available_date, target_local_date) AS lag_days FROM truth"),
)
def a04d(spark, sf):
    out = R.with_lag_days(truth(spark, sf), "target_local_date", "latest_available_date")
    return out.select("o_orderkey", "status", F.col("lag_days").cast("bigint").alias("lag_days"))


READY = """WITH m AS (SELECT CAST(c_custkey AS VARCHAR) AS market_id, city FROM cities),
    f AS (SELECT CAST(user_id AS VARCHAR) AS market_id, count(*) AS forecast_row_count, count(DISTINCT event_type) AS forecast_model_count FROM events GROUP BY 1),
    t AS (SELECT market_id, status AS truth_status FROM truth QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY fetched_at DESC, o_orderkey DESC) = 1),
    o AS (SELECT market_id, count(*) AS truth_daily_count FROM truth WHERE status = 'ok' GROUP BY 1),
    g AS (SELECT CAST(o_custkey AS VARCHAR) AS market_id, count(*) AS gold_row_count, count(DISTINCT l_returnflag) AS gold_horizon_count
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_tax > 0.07 AND l_discount > 0.05 GROUP BY 1),
    d AS (SELECT m.*, coalesce(forecast_row_count, 0) AS forecast_row_count, coalesce(forecast_model_count, 0) AS forecast_model_count,
      truth_status, coalesce(truth_daily_count, 0) AS truth_daily_count, coalesce(gold_row_count, 0) AS gold_row_count,
      coalesce(gold_horizon_count, 0) AS gold_horizon_count,
      CASE WHEN coalesce(gold_row_count, 0) > 0 THEN 'ready' WHEN truth_status = 'lag' THEN 'truth_lag' WHEN truth_status = 'error' THEN 'truth_error'
        WHEN coalesce(forecast_row_count, 0) = 0 THEN 'missing_forecast' WHEN coalesce(truth_daily_count, 0) = 0 THEN 'missing_truth' ELSE 'gold_missing' END AS readiness_status
      FROM m LEFT JOIN f USING (market_id) LEFT JOIN t USING (market_id) LEFT JOIN o USING (market_id) LEFT JOIN g USING (market_id))"""


def readiness(spark, sf):
    tr = truth(spark, sf)
    items = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return R.readiness_details(
        roles.cities(spark, sf).select(F.col("c_custkey").cast("string").alias("market_id"), "city"),
        table(spark, sf, "events").select(F.col("user_id").cast("string").alias("market_id"), F.col("event_type").alias("model_name")),
        tr,
        tr.where(F.col("status") == "ok"),
        items.where((F.col("l_tax") > 0.07) & (F.col("l_discount") > 0.05)).select(
            F.col("o_custkey").cast("string").alias("market_id"), F.col("l_returnflag").alias("decision_horizon")
        ),
        [F.desc("fetched_at"), F.desc("o_orderkey")],
    )


def with_ready(body):
    return with_roles("cities", f"WITH {TRUTH}, {READY[5:]} {body}")


@query("j01_readiness_details", with_ready("SELECT * FROM d"))
def j01(spark, sf):
    """Five-way left join of per-market counts with a readiness ladder."""
    return readiness(spark, sf)


@query(
    "a05_readiness_summary",
    with_ready("""SELECT city, count(*) AS snapshot_count, count(*) FILTER (forecast_row_count > 0) AS forecast_ready_count,
    count(*) FILTER (truth_daily_count > 0) AS truth_ok_count, count(*) FILTER (truth_status = 'lag') AS truth_lag_count,
    count(*) FILTER (truth_status = 'error') AS truth_error_count, count(*) FILTER (gold_row_count > 0) AS gold_market_count,
    CAST(sum(gold_row_count) AS BIGINT) AS gold_row_count FROM d GROUP BY 1"""),
)
def a05(spark, sf):
    return R.readiness_summary(readiness(spark, sf))


REQUESTS = """requests AS (SELECT CAST(o_custkey AS VARCHAR) AS market_id, o_orderpriority AS token_id, c.city, o_orderdate AS requested_at, o_orderkey,
    CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'empty' ELSE 'http_error' END AS status,
    CAST(floor(o_totalprice / 1000) AS BIGINT) AS point_count,
    CASE WHEN o_orderstatus = 'O' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'history_unavailable_last_trade_present'
      WHEN '2-HIGH' THEN 'history_unavailable_last_trade_missing' WHEN '3-MEDIUM' THEN 'history_unavailable_last_trade_error' ELSE 'other' END END AS empty_reason,
    CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_totalprice > 250000 THEN ' True ' ELSE '0' END END AS last_trade_present
    FROM orders LEFT JOIN cities c ON o_custkey = c.c_custkey)"""


def requests(spark, sf):
    status = F.col("o_orderstatus")
    pr = F.col("o_orderpriority")
    reason = (
        F.when(pr == "1-URGENT", "history_unavailable_last_trade_present")
        .when(pr == "2-HIGH", "history_unavailable_last_trade_missing")
        .when(pr == "3-MEDIUM", "history_unavailable_last_trade_error")
        .otherwise("other")
    )
    return (
        table(spark, sf, "orders")
        .join(roles.cities(spark, sf), F.col("o_custkey") == F.col("c_custkey"), "left")
        .select(
            F.col("o_custkey").cast("string").alias("market_id"),
            pr.alias("token_id"),
            "city",
            F.col("o_orderdate").alias("requested_at"),
            "o_orderkey",
            F.when(status == "F", "ok").when(status == "O", "empty").otherwise("http_error").alias("status"),
            F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("point_count"),
            F.when(status == "O", reason).alias("empty_reason"),
            F.when(status == "O", F.when(F.col("o_totalprice") > 250000, " True ").otherwise("0")).alias("last_trade_present"),
        )
    )


@query(
    "a06_price_requests",
    with_roles(
        "cities",
        f"""WITH {REQUESTS}, latest AS (SELECT * FROM requests QUALIFY row_number() OVER (PARTITION BY market_id, token_id ORDER BY requested_at DESC NULLS FIRST, o_orderkey DESC) = 1)
    SELECT status, city, count(*) AS request_count, count(DISTINCT market_id) AS market_count, CAST(sum(point_count) AS BIGINT) AS total_points,
    count(last_trade_present) AS last_trade_probe_count, count(*) FILTER (lower(trim(last_trade_present)) IN ('true', '1', '1.0', 'yes', 'y')) AS last_trade_present_count,
    count(*) FILTER (empty_reason = 'history_unavailable_last_trade_present') AS history_empty_with_last_trade_count,
    count(*) FILTER (empty_reason = 'history_unavailable_last_trade_missing') AS history_empty_without_last_trade_count,
    count(*) FILTER (empty_reason LIKE 'history\\_unavailable\\_last\\_trade\\_%' ESCAPE '\\' AND empty_reason NOT IN ('history_unavailable_last_trade_present', 'history_unavailable_last_trade_missing')) AS history_empty_last_trade_error_count
    FROM latest GROUP BY ALL""",
    ),
)
def a06(spark, sf):
    from skyledger.operators.merge import keep_last

    latest = keep_last(requests(spark, sf), ["market_id", "token_id"], ["requested_at", "o_orderkey"])
    return R.price_request_summary(latest)


AVAIL = """avail AS (SELECT c.city, l_returnflag AS model_name, CASE l_linestatus WHEN 'F' THEN 'single_run' ELSE 'historical' END AS endpoint_kind,
    CASE WHEN l_tax < 0.03 THEN 'probe' ELSE 'full' END AS request_kind, CASE WHEN l_discount > 0.05 THEN coalesce(o_orderpriority, 'generic') ELSE 'generic' END AS decision_horizon,
    l_orderkey AS market_id, l_shipdate AS requested_at, CASE o_orderstatus WHEN 'F' THEN 'available' WHEN 'O' THEN 'unavailable' ELSE CASE WHEN l_quantity > 25 THEN 'error' END END AS availability_status
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN cities c ON o_custkey = c.c_custkey),
  summary AS (SELECT city, model_name, endpoint_kind, request_kind, decision_horizon, count(market_id) AS requests,
    count(*) FILTER (availability_status IN ('available', 'demo_fixture')) AS available_requests, count(*) FILTER (availability_status = 'unavailable') AS unavailable_requests,
    count(*) FILTER (availability_status = 'error') AS error_requests, epoch_us(max(requested_at)) AS last_requested_us,
    round(count(*) FILTER (availability_status IN ('available', 'demo_fixture')) / greatest(count(market_id), 1), 6) AS availability_ratio FROM avail GROUP BY ALL)"""


def availability(spark, sf):
    df = (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(roles.cities(spark, sf), F.col("o_custkey") == F.col("c_custkey"), "left")
        .select(
            "city",
            F.col("l_returnflag").alias("model_name"),
            F.when(F.col("l_linestatus") == "F", "single_run").otherwise("historical").alias("endpoint_kind"),
            F.when(F.col("l_tax") < 0.03, "probe").otherwise("full").alias("request_kind"),
            F.when(F.col("l_discount") > 0.05, F.col("o_orderpriority")).alias("decision_horizon"),
            F.col("l_orderkey").alias("market_id"),
            F.col("l_shipdate").alias("requested_at"),
            F.when(F.col("o_orderstatus") == "F", "available")
            .when(F.col("o_orderstatus") == "O", "unavailable")
            .when(F.col("l_quantity") > 25, "error")
            .alias("availability_status"),
        )
    )
    return R.forecast_availability(df)


def availability_out(df):
    return df.withColumn("last_requested_us", F.unix_micros("last_requested_at")).drop("last_requested_at").withColumn(
        "availability_ratio", F.round("availability_ratio", 6)
    )


@query("a08_forecast_availability", with_roles("cities", f"WITH {AVAIL} SELECT * FROM summary"))
def a08(spark, sf):
    return availability_out(availability(spark, sf))


@query(
    "w04_recommended_models",
    with_roles(
        "cities",
        f"""WITH {AVAIL} SELECT * FROM summary WHERE request_kind IN ('full', 'single_run') AND available_requests > 0
    QUALIFY row_number() OVER (PARTITION BY city, decision_horizon ORDER BY availability_ratio DESC, available_requests DESC, model_name, endpoint_kind, request_kind) <= 3""",
    ),
)
def w04(spark, sf):
    """Top three models per city and horizon."""
    return R.recommended_models(availability_out(availability(spark, sf)), 3)


@query(
    "a09_empty_build_diagnostics",
    with_roles(
        "hourly",
        """WITH g AS (SELECT count(*) AS n, count(temperature_2m) FILTER (local_date = target_local_date) AS present,
      max(abs(temperature_2m)) FILTER (local_date = target_local_date) AS largest, count(issue_time_utc) AS dated, endpoint_kind
      FROM hourly GROUP BY market_id, endpoint_kind, decision_horizon)
    SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS groups, count(*) FILTER (present > 0) AS nonnull_target_groups, count(*) FILTER (present = 0) AS all_null_target_groups,
    count(*) FILTER (largest <= 1e-9) AS all_zero_target_groups, count(*) FILTER (endpoint_kind = 'historical_forecast' AND dated = 0) AS historical_missing_issue_groups FROM g""",
    ),
)
def a09(spark, sf):
    return R.empty_build_diagnostics(roles.hourly(spark, sf))


@query(
    "a50_lagged_stations",
    with_truth("""SELECT city, o_orderkey, CASE WHEN latest_available_date IS NULL THEN 'archive lag' ELSE 'latest ' || strftime(latest_available_date, '%Y-%m-%d') END AS lag_note
    FROM truth WHERE status = 'lag' ORDER BY fetched_at, o_orderkey LIMIT 3"""),
)
def a50(spark, sf):
    out = R.lagged_stations(truth(spark, sf), [F.asc("fetched_at"), F.asc("o_orderkey")])
    return out.select("city", "o_orderkey", "lag_note")


# --- panel ----------------------------------------------------------------------


@query(
    "a13_coverage_bottlenecks",
    with_roles(
        "panel",
        """SELECT city, decision_horizon, count(*) AS rows, count(*) FILTER (coverage_status = 'ok') AS ok, count(*) FILTER (coverage_status = 'stale') AS stale,
    count(*) FILTER (coverage_status = 'missing') AS missing, round(count(*) FILTER (coverage_status = 'ok') / count(*), 6) AS ok_ratio
    FROM panel GROUP BY ALL ORDER BY ok_ratio, city, decision_horizon LIMIT 6""",
    ),
)
def a13(spark, sf):
    """The six city and horizon slices with the thinnest price coverage."""
    out = rounded(R.coverage_by_group(roles.panel(spark, sf), ["city", "decision_horizon"]), "ok_ratio")
    return out.orderBy("ok_ratio", "city", "decision_horizon").limit(6)


@query(
    "a39_decision_readiness",
    with_roles(
        "panel",
        """WITH m AS (SELECT count(*) AS n, count(*) FILTER (coverage_status = 'ok') AS ok FROM panel GROUP BY market_id, decision_id)
    SELECT count(*) AS decision_rows, count(*) FILTER (ok = n) AS ready_rows FROM m""",
    ),
)
def a39(spark, sf):
    return R.decision_readiness(roles.panel(spark, sf), ["market_id", "decision_id"])


@query(
    "a15_panel_coverage_total",
    with_roles(
        "panel",
        """SELECT count(*) AS rows, count(*) FILTER (coverage_status = 'ok') AS ok, count(*) FILTER (coverage_status = 'stale') AS stale,
    count(*) FILTER (coverage_status = 'missing') AS missing, round(count(*) FILTER (coverage_status = 'ok') / count(*), 6) AS ok_ratio FROM panel""",
    ),
)
def a15(spark, sf):
    """Entry-wise sum of per-city coverage maps."""
    per = R.coverage_by_group(roles.panel(spark, sf), ["city"]).select(
        "rows", F.create_map(*[x for s in ("ok", "stale", "missing") for x in (F.lit(s), F.col(s))]).alias("coverage")
    )
    out = R.panel_coverage_total(per)
    return rounded(out, "ok_ratio").select(
        "rows", *[F.element_at("coverage", F.lit(s)).alias(s) for s in ("ok", "stale", "missing")], "ok_ratio"
    )


# --- logs -------------------------------------------------------------------------

LEVELS = {"all": [], "city": ["city"], "horizon": ["decision_horizon"], "city_horizon": ["city", "decision_horizon"], "reason": ["reason"]}
LEVEL_SQL = """leveled AS (SELECT o.*, u.level, u.grp FROM (SELECT *, unnest([{'level': 'all', 'grp': 'all'}, {'level': 'city', 'grp': coalesce(city, 'unknown')},
    {'level': 'horizon', 'grp': decision_horizon}, {'level': 'city_horizon', 'grp': coalesce(city, 'unknown') || ':' || decision_horizon},
    {'level': 'reason', 'grp': reason}]) AS u FROM opportunities) o)"""
LOG_COLUMNS = """level, grp, count(DISTINCT observed_at) AS cycles, count(*) AS markets_evaluated, count(*) FILTER (reason = 'tradable') AS tradable_count,
    count(*) FILTER (raw_gap > 0) AS raw_gap_positive_count, count(*) FILTER (after_cost_edge > 0) AS after_cost_edge_positive_count,
    max(raw_gap) AS best_raw_gap, max(after_cost_edge) AS best_after_cost_edge"""
GATE_SQL = """CASE WHEN after_cost_edge_positive_count >= 2 THEN 'GO' WHEN after_cost_edge_positive_count = 1 OR cycles <= 1 THEN 'INCONCLUSIVE' ELSE 'NO_GO' END AS gate_decision,
    CASE WHEN after_cost_edge_positive_count >= 2 THEN 'repeated_after_cost_positive_edges' WHEN after_cost_edge_positive_count = 1 THEN 'single_after_cost_positive_edge'
      WHEN cycles <= 1 THEN 'single_cycle_only' WHEN raw_gap_positive_count <= 0 THEN 'raw_gap_never_positive' ELSE 'after_cost_edge_never_positive' END AS gate_reason"""


def log_sql(extra="", levels=LEVEL_SQL):
    inner = f"SELECT {LOG_COLUMNS}{extra} FROM leveled GROUP BY level, grp"
    return with_roles("opportunities", f"WITH {levels}, s AS ({inner}) SELECT *, {GATE_SQL} FROM s")


@query("a16_opportunity_summary", log_sql(", round(median(spread), 8) AS median_spread, round(median(k), 8) AS median_visible_liquidity"))
def a16(spark, sf):
    """Opportunity log: overall, by city, horizon, city and horizon, and reason."""
    out = R.log_summary(
        roles.opportunities(spark, sf), LEVELS, {"spread": "median_spread", "k": "median_visible_liquidity"}
    )
    return rounded(out, "median_spread", "median_visible_liquidity", digits=8)


QUEUE_SQL = "CASE WHEN reason = 'tradable' AND k < 60 THEN 'tradable' WHEN k < 80 THEN 'manual_review' ELSE 'blocked' END"
FLAGS_SQL = "list_filter([CASE WHEN k > 50 THEN 'observation_stale' END, CASE WHEN spread > 0.1 THEN 'spread_too_wide' END, CASE WHEN after_cost_edge IS NULL THEN 'missing_book' END], lambda x: x IS NOT NULL)"


def observation_log(spark, sf):
    o = roles.opportunities(spark, sf)
    return o.withColumn(
        "queue_state",
        F.when((F.col("reason") == "tradable") & (F.col("k") < 60), "tradable").when(F.col("k") < 80, "manual_review").otherwise("blocked"),
    ).withColumn(
        "risk_flags",
        F.array_compact(
            F.array(
                F.when(F.col("k") > 50, "observation_stale"),
                F.when(F.col("spread") > 0.1, "spread_too_wide"),
                F.when(F.col("after_cost_edge").isNull(), "missing_book"),
            )
        ),
    )


@query(
    "a17_observation_summary",
    log_sql(f""", count(*) FILTER ({QUEUE_SQL} = 'manual_review') AS manual_review_count, count(*) FILTER ({QUEUE_SQL} = 'tradable') AS queue_tradable_count,
    round(median(k), 8) AS median_freshness"""),
)
def a17(spark, sf):
    """Observation log with queue states and freshness."""
    extra = [
        R.count_if(F.col("queue_state") == "manual_review").alias("manual_review_count"),
        R.count_if(F.col("queue_state") == "tradable").alias("queue_tradable_count"),
    ]
    out = R.log_summary(observation_log(spark, sf), LEVELS, {"k": "median_freshness"}, extra)
    return rounded(out, "median_freshness", digits=8)


@query(
    "a17_risk_flag_counts",
    with_roles("opportunities", f"WITH {LEVEL_SQL} SELECT level, grp, flag, count(*) AS n FROM (SELECT level, grp, unnest({FLAGS_SQL}) AS flag FROM leveled) GROUP BY ALL"),
)
def a17f(spark, sf):
    return R.flag_counts(observation_log(spark, sf), LEVELS, "risk_flags")


AGE_SQL = "CASE WHEN k IS NULL THEN 'unknown' WHEN k <= 6 THEN '0-6h' WHEN k <= 24 THEN '6-24h' WHEN k <= 48 THEN '24-48h' ELSE '48h+' END"
PRIORITY_SQL = "CASE WHEN k <= 24 THEN CASE WHEN spread > 0.1 THEN 'fresh_listing_spread_blocked' ELSE 'fresh_listing' END WHEN k <= 60 THEN 'mature_core' ELSE 'mature_expansion' END"


def hope_log(spark, sf):
    from skyledger.functions.clock import age_bucket

    o = roles.opportunities(spark, sf)
    return o.withColumn("age_bucket", age_bucket(F.col("k"))).withColumn(
        "priority_bucket",
        F.when(F.col("k") <= 24, F.when(F.col("spread") > 0.1, "fresh_listing_spread_blocked").otherwise("fresh_listing"))
        .when(F.col("k") <= 60, "mature_core")
        .otherwise("mature_expansion"),
    )


HOPE_LEVELS = {"all": [], "city": ["city"], "age_bucket": ["age_bucket"], "priority_bucket": ["priority_bucket"]}
HOPE_LEVEL_SQL = f"""leveled AS (SELECT o.*, u.level, u.grp FROM (SELECT *, {PRIORITY_SQL} AS priority_bucket, unnest([{{'level': 'all', 'grp': 'all'}}, {{'level': 'city', 'grp': coalesce(city, 'unknown')}},
    {{'level': 'age_bucket', 'grp': {AGE_SQL}}}, {{'level': 'priority_bucket', 'grp': {PRIORITY_SQL}}}]) AS u FROM opportunities) o)"""


@query(
    "a18_hope_hunt_summary",
    log_sql(
        """, count(*) FILTER (priority_bucket LIKE 'fresh%') AS fresh_listing_count, count(*) FILTER (priority_bucket LIKE 'mature%') AS mature_market_count,
    round(median(k), 8) AS median_open_phase_age_hours""",
        HOPE_LEVEL_SQL,
    ),
)
def a18(spark, sf):
    bucket = F.col("priority_bucket")
    extra = [
        R.count_if(bucket.isin("fresh_listing", "fresh_listing_spread_blocked")).alias("fresh_listing_count"),
        R.count_if(bucket.isin("mature_core", "mature_expansion", "unknown_open_time")).alias("mature_market_count"),
    ]
    out = R.log_summary(hope_log(spark, sf), HOPE_LEVELS, {"k": "median_open_phase_age_hours"}, extra)
    return rounded(out, "median_open_phase_age_hours", digits=8)


OPEN_LEVELS = {"all": [], "city": ["city"], "horizon": ["decision_horizon"], "city_horizon": ["city", "decision_horizon"], "age_bucket": ["age_bucket"]}
OPEN_LEVEL_SQL = f"""leveled AS (SELECT o.*, u.level, u.grp FROM (SELECT *, unnest([{{'level': 'all', 'grp': 'all'}}, {{'level': 'city', 'grp': coalesce(city, 'unknown')}},
    {{'level': 'horizon', 'grp': decision_horizon}}, {{'level': 'city_horizon', 'grp': coalesce(city, 'unknown') || ':' || decision_horizon}},
    {{'level': 'age_bucket', 'grp': {AGE_SQL}}}]) AS u FROM opportunities) o)"""


@query(
    "a19_open_phase_summary",
    log_sql(
        ", min(k) AS min_open_phase_age_hours, max(k) AS max_open_phase_age_hours, round(median(spread), 8) AS median_spread, round(median(k), 8) AS median_open_phase_age_hours",
        OPEN_LEVEL_SQL,
    ),
)
def a19(spark, sf):
    extra = [F.min("k").alias("min_open_phase_age_hours"), F.max("k").alias("max_open_phase_age_hours")]
    out = R.log_summary(
        hope_log(spark, sf), OPEN_LEVELS, {"spread": "median_spread", "k": "median_open_phase_age_hours"}, extra
    )
    return rounded(out, "median_spread", "median_open_phase_age_hours", digits=8)


@query(
    "a20_nested_reason_counts",
    with_roles("opportunities", "SELECT coalesce(city, 'unknown') AS grp, reason AS item, count(*) AS n FROM opportunities GROUP BY ALL"),
)
def a20(spark, sf):
    return R.nested_counts(roles.opportunities(spark, sf), "city", "reason")


@query(
    "a21_report_summary",
    with_roles(
        "opportunities",
        f"""WITH {LEVEL_SQL} SELECT level, grp, count(*) AS evaluation_rows, count(*) FILTER (reason = 'tradable') AS tradable_rows,
    count(*) FILTER (reason = 'tradable' AND k > 50) AS fills, round(coalesce(sum(spread * k) FILTER (reason = 'tradable' AND k > 50), 0), 6) AS filled_notional,
    round(median(spread), 8) AS median_spread FROM leveled GROUP BY ALL""",
    ),
)
def a21(spark, sf):
    """Generic report rows by city, horizon and reason with the filled notional."""
    o = roles.opportunities(spark, sf)
    fill = F.when((F.col("reason") == "tradable") & (F.col("k") > 50), F.col("spread") * F.col("k"))
    extra = [F.count("fill").alias("fills"), F.round(F.coalesce(F.sum("fill"), F.lit(0.0)), 6).alias("filled_notional")]
    out = R.log_summary(o.withColumn("fill", fill), LEVELS, {"spread": "median_spread"}, extra)
    return out.select(
        "level",
        "grp",
        F.col("markets_evaluated").alias("evaluation_rows"),
        F.col("tradable_count").alias("tradable_rows"),
        "fills",
        "filled_notional",
        F.round("median_spread", 8).alias("median_spread"),
    )


@query(
    "a22_signal_rollup",
    with_roles(
        "opportunities",
        """SELECT count(*) AS row_count, count(*) FILTER (reason = 'tradable') AS tradable_count, count(after_cost_edge) AS edge_count,
    count(*) FILTER (after_cost_edge > 0) AS positive_count, max(after_cost_edge) AS max_edge, round(avg(after_cost_edge), 6) AS mean_edge FROM opportunities""",
    ),
)
def a22(spark, sf):
    out = R.signal_rollup(roles.opportunities(spark, sf).withColumnRenamed("after_cost_edge", "edge"))
    return rounded(out, "mean_edge")


@query(
    "a22_book_source_counts",
    "SELECT event_type AS key, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1",
)
def a22m(spark, sf):
    """Entry-wise sum of a map column."""
    e = table(spark, sf, "events").select(
        F.create_map("event_type", F.get_json_object("props", "$.k").cast("bigint")).alias("book_source_counts")
    )
    return R.sum_maps(e, "book_source_counts")


NEAR_SQL = ", ".join(f"'{r}'" for r in R.NEAR_MISS_REASONS)
TOP_COLS = "event_id, city, decision_horizon, reason, raw_gap, after_cost_edge, spread"


@query(
    "o02_near_misses",
    with_roles(
        "opportunities",
        f"SELECT {TOP_COLS} FROM opportunities WHERE reason IN ({NEAR_SQL}) ORDER BY after_cost_edge DESC NULLS LAST, raw_gap DESC NULLS LAST, observed_at, market_id, event_id LIMIT 10",
    ),
)
def o02(spark, sf):
    order = [F.desc_nulls_last("after_cost_edge"), F.desc_nulls_last("raw_gap"), F.asc("observed_at"), F.asc("market_id"), F.asc("event_id")]
    return R.top_rows(roles.opportunities(spark, sf), 10, order, R.NEAR_MISS_REASONS).select(*TOP_COLS.split(", "))


@query(
    "o02_spread_blocked",
    with_roles(
        "opportunities",
        f"SELECT {TOP_COLS} FROM opportunities WHERE reason IN ('after_cost_positive_but_spread_too_wide', 'slippage_killed_edge', 'insufficient_depth') ORDER BY spread DESC NULLS LAST, raw_gap DESC NULLS LAST, observed_at, market_id, event_id LIMIT 10",
    ),
)
def o02s(spark, sf):
    order = [F.desc_nulls_last("spread"), F.desc_nulls_last("raw_gap"), F.asc("observed_at"), F.asc("market_id"), F.asc("event_id")]
    return R.top_rows(roles.opportunities(spark, sf), 10, order, R.SPREAD_REASONS).select(*TOP_COLS.split(", "))


@query(
    "o02_zero_ranked_missing",
    with_roles(
        "opportunities",
        f"SELECT {TOP_COLS} FROM opportunities WHERE reason = 'fee_killed_edge' ORDER BY nullif(raw_gap, 0) DESC NULLS LAST, city, market_id, event_id LIMIT 10",
    ),
)
def o02z(spark, sf):
    """The generic report ranks an exact zero as missing."""
    order = [F.desc_nulls_last("__rank_raw_gap"), F.asc_nulls_last("city"), F.asc("market_id"), F.asc("event_id")]
    return R.top_rows(roles.opportunities(spark, sf), 10, order, ["fee_killed_edge"], ["raw_gap"]).select(*TOP_COLS.split(", "))


@query(
    "o03_blocker_watchlist",
    with_roles(
        "opportunities",
        """SELECT coalesce(city, 'unknown') AS city, count(*) FILTER (reason = 'fee_killed_edge') AS blocked, count(*) AS evaluation_rows,
    round(count(*) FILTER (reason = 'fee_killed_edge') / count(*), 6) AS ratio FROM opportunities GROUP BY 1 HAVING blocked > 0 ORDER BY blocked DESC, ratio DESC, city LIMIT 10""",
    ),
)
def o03(spark, sf):
    return R.blocker_watchlist(roles.opportunities(spark, sf), "city", "fee_killed_edge")


@query(
    "o04_tradable_first",
    with_roles(
        "opportunities",
        f"SELECT {TOP_COLS} FROM opportunities ORDER BY reason <> 'tradable', after_cost_edge DESC NULLS LAST, event_id LIMIT 25",
    ),
)
def o04(spark, sf):
    order = [F.asc(F.col("reason") != "tradable"), F.desc_nulls_last("after_cost_edge"), F.asc("event_id")]
    return R.top_rows(roles.opportunities(spark, sf), 25, order).select(*TOP_COLS.split(", "))


@query(
    "o05_alert_first",
    with_roles(
        "opportunities",
        f"SELECT {TOP_COLS}, k FROM opportunities ORDER BY (k > 90) DESC, k DESC NULLS LAST, after_cost_edge DESC NULLS LAST, event_id LIMIT 10",
    ),
)
def o05(spark, sf):
    order = [F.desc(F.col("k") > 90), F.desc_nulls_last("k"), F.desc_nulls_last("after_cost_edge"), F.asc("event_id")]
    return R.top_rows(roles.opportunities(spark, sf), 10, order).select(*TOP_COLS.split(", "), "k")


@query(
    "s31_path_gates",
    with_roles("opportunities", f"WITH {LEVEL_SQL}, s AS (SELECT {LOG_COLUMNS} FROM leveled GROUP BY level, grp) SELECT level, grp, {GATE_SQL} FROM s"),
)
def s31(spark, sf):
    return R.log_summary(roles.opportunities(spark, sf), LEVELS).select("level", "grp", "gate_decision", "gate_reason")


@query(
    "s31_revenue_gate",
    with_roles(
        "opportunities",
        f"""WITH {LEVEL_SQL}, s AS (SELECT {LOG_COLUMNS} FROM leveled GROUP BY level, grp), g AS (SELECT *, {GATE_SQL} FROM s),
    p AS (SELECT max(gate_decision) FILTER (grp = 'tradable') AS b, max(gate_decision) FILTER (grp = 'fee_killed_edge') AS p1, max(gate_decision) FILTER (grp = 'missing_book') AS p2 FROM g WHERE level = 'reason')
    SELECT CASE WHEN b = 'NO_GO' THEN 'NO_GO' WHEN coalesce(b, '') <> 'GO' THEN 'INCONCLUSIVE' WHEN p1 = 'GO' OR p2 = 'GO' THEN 'GO' WHEN p1 = 'NO_GO' AND p2 = 'NO_GO' THEN 'NO_GO' ELSE 'INCONCLUSIVE' END AS decision FROM p""",
    ),
)
def s31r(spark, sf):
    """Benchmark gate combined with two live-path gates."""
    g = R.log_summary(roles.opportunities(spark, sf), {"reason": ["reason"]})
    pick = lambda r: F.max(F.when(F.col("grp") == r, F.col("gate_decision")))
    p = g.agg(pick("tradable").alias("b"), pick("fee_killed_edge").alias("p1"), pick("missing_book").alias("p2"))
    return p.select(R.revenue_gate(F.col("b"), F.col("p1"), F.col("p2")).decision.alias("decision"))


# --- trades ---------------------------------------------------------------------


@query(
    "a10_trade_summary",
    with_roles(
        "trades",
        "SELECT count(*) AS num_trades, round(sum(realized_pnl), 2) AS pnl, round(avg(CAST(realized_pnl > 0 AS INT)), 6) AS hit_rate, round(avg(edge), 6) AS avg_edge FROM trades",
    ),
)
def a10(spark, sf):
    out = R.trade_summary(roles.trades(spark, sf)).drop("avg_price")
    return rounded(rounded(out, "hit_rate", "avg_edge"), "pnl", digits=2)


@query(
    "a11_trade_report",
    with_roles(
        "trades",
        """WITH l AS (SELECT t.*, u.level, u.grp FROM (SELECT *, unnest([{'level': 'all', 'grp': 'all'}, {'level': 'horizon', 'grp': decision_horizon}, {'level': 'city', 'grp': coalesce(city, 'unknown')}]) AS u FROM trades) t)
    SELECT level, grp, count(*) AS trades, round(sum(realized_pnl), 2) AS pnl, round(avg(realized_pnl), 6) AS pnl_per_trade, round(avg(CAST(realized_pnl > 0 AS INT)), 6) AS hit_rate,
    round(avg(price), 6) AS avg_price, round(avg(edge), 6) AS avg_edge, round(avg(price_age_seconds) / 60, 6) AS avg_price_age_min, round(median(edge), 6) AS median_edge FROM l GROUP BY ALL""",
    ),
)
def a11(spark, sf):
    out = R.trade_report(roles.trades(spark, sf), {"all": [], "horizon": ["decision_horizon"], "city": ["city"]})
    out = rounded(out, "pnl_per_trade", "hit_rate", "avg_price", "avg_edge", "avg_price_age_min", "median_edge")
    return rounded(out, "pnl", digits=2)


POLICY = [("NATION_1", ["1-URGENT", "2-HIGH"]), ("NATION_2", ["3-MEDIUM"]), ("NATION_3", ["5-LOW", "1-URGENT"])]
POLICY_SQL = "policy AS (SELECT * FROM (VALUES ('NATION_1', '1-URGENT'), ('NATION_1', '2-HIGH'), ('NATION_2', '3-MEDIUM'), ('NATION_3', '5-LOW'), ('NATION_3', '1-URGENT')) p(city, horizon))"


@query(
    "f04_policy_filter",
    with_roles("trades", f"WITH {POLICY_SQL} SELECT market_id, line FROM trades t WHERE coalesce(t.city, '') NOT IN (SELECT city FROM policy) OR EXISTS (SELECT 1 FROM policy p WHERE p.city = t.city AND p.horizon = t.decision_horizon)"),
)
def f04(spark, sf):
    """An unlisted city allows every horizon."""
    from skyledger.operators.trade import policy_filter

    return policy_filter(roles.trades(spark, sf), POLICY).select("market_id", "line")


@query(
    "f04b_strict_policy",
    with_roles("trades", f"WITH {POLICY_SQL} SELECT market_id, line FROM trades t WHERE EXISTS (SELECT 1 FROM policy p WHERE p.city = t.city AND p.horizon = t.decision_horizon)"),
)
def f04b(spark, sf):
    """An unlisted city allows nothing."""
    from skyledger.operators.trade import policy_filter

    return policy_filter(roles.trades(spark, sf), POLICY, strict=True).select("market_id", "line")


@query(
    "a12_policy_trades",
    with_roles(
        "trades",
        f"""WITH {POLICY_SQL} SELECT t.city, t.decision_horizon, count(*) AS num_trades, round(sum(realized_pnl), 2) AS pnl, round(avg(CAST(realized_pnl > 0 AS INT)), 6) AS hit_rate, sum(realized_pnl) < 0 AS losing
    FROM trades t JOIN policy p ON p.city = t.city AND p.horizon = t.decision_horizon GROUP BY ALL""",
    ),
)
def a12(spark, sf):
    from skyledger.operators.trade import policy_filter

    out = R.trade_summary(policy_filter(roles.trades(spark, sf), POLICY, strict=True), ["city", "decision_horizon"])
    return out.select(
        "city", "decision_horizon", "num_trades", F.round("pnl", 2).alias("pnl"), F.round("hit_rate", 6).alias("hit_rate"), (F.col("pnl") < 0).alias("losing")
    )


CITY_METRICS = """m AS (SELECT city, count(*) AS num_trades, sum(realized_pnl) AS pnl, count(*) FILTER (price > 0.1) AS priced_decision_rows,
    avg(CAST(realized_pnl > 0 AS INT)) AS hit_rate, avg(edge) AS avg_edge, avg(price_age_seconds) AS avg_price_age_seconds FROM trades GROUP BY city)"""


def city_metrics(spark, sf):
    return roles.trades(spark, sf).groupBy("city").agg(
        F.count("*").alias("num_trades"),
        F.sum("realized_pnl").alias("pnl"),
        R.count_if(F.col("price") > 0.1).alias("priced_decision_rows"),
        R.share(F.col("realized_pnl") > 0).alias("hit_rate"),
        F.avg("edge").alias("avg_edge"),
        F.avg("price_age_seconds").alias("avg_price_age_seconds"),
    )


@query(
    "a14_weighted_metrics",
    with_roles(
        "trades",
        f"""WITH {CITY_METRICS} SELECT CAST(sum(num_trades) AS BIGINT) AS num_trades, round(sum(pnl), 2) AS pnl, CAST(sum(priced_decision_rows) AS BIGINT) AS priced_decision_rows,
    round(sum(hit_rate * num_trades) / sum(num_trades), 6) AS hit_rate, round(sum(avg_edge * num_trades) / sum(num_trades), 6) AS avg_edge,
    round(sum(avg_price_age_seconds * priced_decision_rows) / sum(priced_decision_rows), 4) AS avg_price_age_seconds FROM m""",
    ),
)
def a14(spark, sf):
    """Per-city metrics rolled up with trade weights."""
    out = R.aggregate_backtests(city_metrics(spark, sf))
    out = rounded(rounded(out, "hit_rate", "avg_edge"), "pnl", digits=2)
    return rounded(out, "avg_price_age_seconds", digits=4)


def gate_metrics(spark, sf):
    return city_metrics(spark, sf).select(
        "city",
        F.col("num_trades").alias("policy_trades"),
        F.col("pnl").alias("policy_pnl"),
        F.col("priced_decision_rows").alias("priced_rows"),
        F.col("num_trades").alias("panel_rows"),
        F.col("priced_decision_rows").alias("panel_ok_rows"),
    )


@query(
    "s31_city_gates",
    with_roles(
        "trades",
        f"""WITH {CITY_METRICS} SELECT city, round(priced_decision_rows / num_trades, 6) AS panel_ok_ratio, priced_decision_rows / num_trades >= 0.905 AS passes_panel_coverage,
    num_trades >= 30 AS passes_trade_count, pnl >= 0 AS passes_non_negative_pnl, priced_decision_rows / num_trades >= 0.905 AND num_trades >= 30 AND pnl >= 0 AS passes FROM m""",
    ),
)
def s31c(spark, sf):
    out = R.city_gates(gate_metrics(spark, sf), 30, 0.905)
    return rounded(out, "panel_ok_ratio").select(
        "city", "panel_ok_ratio", "passes_panel_coverage", "passes_trade_count", "passes_non_negative_pnl", "passes"
    )


GATE_LADDER = """SELECT CAST(sum(num_trades) AS DOUBLE) AS policy_trades, CASE WHEN sum(num_trades) < 300 THEN 'insufficient_sample' WHEN NOT bool_and(priced_decision_rows / num_trades >= 0.5) THEN 'city_panel_coverage_inadequate'
    WHEN NOT bool_and(num_trades >= 30) THEN 'city_real_history_sample_inadequate' WHEN NOT bool_and(pnl >= 0) THEN 'city_real_history_negative_pnl'
    WHEN sum(pnl) > 0 THEN 'positive_policy_pnl_real_history_with_city_gates' ELSE 'non_positive_policy_pnl_real_history' END AS decision_reason"""


@query("s31_profitability_gate", with_roles("trades", f"WITH {CITY_METRICS} {GATE_LADDER} FROM m"))
def s31p(spark, sf):
    out = R.profitability_gate(gate_metrics(spark, sf), 300, 300, 0.5, 30)
    return out.select("policy_trades", "decision_reason")


@query(
    "s31_reduced_core",
    with_roles("trades", f"WITH {CITY_METRICS} {GATE_LADDER}, count(*) AS eligible_cities FROM m WHERE priced_decision_rows / num_trades >= 0.5"),
)
def s31x(spark, sf):
    """The gate again over cities that pass coverage."""
    out = R.reduced_core_gate(
        gate_metrics(spark, sf), 2, 0.5, min_policy_trades=300, min_priced_rows=300, min_city_trades=30
    )
    return out.select("policy_trades", "decision_reason", "eligible_cities")


PRICE_EDGES = [0, 0.03, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 1.01]
PRICE_LABELS = ["0-3c", "3-5c", "5-10c", "10-20c", "20-40c", "40-60c", "60-80c", "80-100c"]


@query(
    "a24_price_buckets",
    with_roles(
        "trades",
        """SELECT CASE WHEN price <= 0.03 THEN '0-3c' WHEN price <= 0.05 THEN '3-5c' WHEN price <= 0.1 THEN '5-10c' WHEN price <= 0.2 THEN '10-20c' WHEN price <= 0.4 THEN '20-40c'
    WHEN price <= 0.6 THEN '40-60c' WHEN price <= 0.8 THEN '60-80c' WHEN price <= 1.01 THEN '80-100c' END AS bucket, count(*) AS trades, round(sum(realized_pnl), 2) AS pnl, round(median(edge), 6) AS median_edge FROM trades GROUP BY 1""",
    ),
)
def a24(spark, sf):
    t = roles.trades(spark, sf).withColumn("bucket", R.cut(F.col("price"), PRICE_EDGES, PRICE_LABELS))
    out = R.trade_report(t, {"bucket": ["bucket"]})
    return out.select(F.col("grp").alias("bucket"), "trades", F.round("pnl", 2).alias("pnl"), F.round("median_edge", 6).alias("median_edge"))


@query(
    "a25_accuracy_by_band",
    with_roles(
        "trades",
        """SELECT CASE WHEN price < 0.2 THEN '0-0.2' WHEN price < 0.4 THEN '0.2-0.4' WHEN price < 0.6 THEN '0.4-0.6' WHEN price < 0.8 THEN '0.6-0.8' WHEN price < 1 THEN '0.8-1' END AS bucket,
    count(*) AS n, round(avg(CAST(outcome_label = winning_outcome AS INT)), 6) AS accuracy FROM trades GROUP BY 1 HAVING count(*) >= 3""",
    ),
)
def a25(spark, sf):
    band = R.price_band(F.col("price"), [0, 0.2, 0.4, 0.6, 0.8, 1])
    out = R.accuracy_by(roles.trades(spark, sf), band, F.col("outcome_label") == F.col("winning_outcome"), 3)
    return rounded(out, "accuracy")


GRID = dict(min_edges=[0.0, 0.05, 0.10, 0.15, 0.20, 0.30, 0.40, 0.50, 0.75, 1.0], min_prices=[0.0, 0.03, 0.05, 0.10, 0.15, 0.20], max_prices=[0.60, 0.75, 0.90, 1.0])
GRID_SQL = """WITH g AS (SELECT * FROM (VALUES (0.0), (0.05), (0.1), (0.15), (0.2), (0.3), (0.4), (0.5), (0.75), (1.0)) a(min_edge),
    (VALUES (0.0), (0.03), (0.05), (0.1), (0.15), (0.2)) b(min_price), (VALUES (0.6), (0.75), (0.9), (1.0)) c(max_price)),
  r AS (SELECT CAST(min_edge AS DOUBLE) AS min_edge, CAST(min_price AS DOUBLE) AS min_price, CAST(max_price AS DOUBLE) AS max_price, count(*) AS trades, round(sum(realized_pnl), 4) AS pnl,
    round(avg(realized_pnl), 6) AS pnl_per_trade, round(avg(CAST(realized_pnl > 0 AS INT)), 6) AS hit_rate FROM trades JOIN g ON edge >= CAST(min_edge AS DOUBLE) AND price >= CAST(min_price AS DOUBLE) AND price <= CAST(max_price AS DOUBLE) GROUP BY ALL HAVING count(*) >= 5)"""


@query("j18_filter_grid", with_roles("trades", f"{GRID_SQL} SELECT * FROM r"))
def j18(spark, sf):
    """All 240 filter combinations from one pass over the trades."""
    out = R.filter_grid(roles.trades(spark, sf), **GRID, limit=None)
    return out.select("min_edge", "min_price", "max_price", "trades", F.round("pnl", 4).alias("pnl"), F.round("pnl_per_trade", 6).alias("pnl_per_trade"), F.round("hit_rate", 6).alias("hit_rate"))


@query(
    "o06_best_filters",
    with_roles("trades", f"{GRID_SQL} SELECT min_edge, min_price, max_price, trades, pnl FROM r ORDER BY pnl DESC, pnl_per_trade DESC, min_edge, min_price, max_price LIMIT 30"),
)
def o06(spark, sf):
    out = R.filter_grid(roles.trades(spark, sf), **GRID)
    return out.select("min_edge", "min_price", "max_price", "trades", F.round("pnl", 4).alias("pnl"))


@query(
    "a48_trades_by_horizon",
    with_roles("trades", "SELECT decision_horizon, count(*) AS num_trades, round(sum(realized_pnl), 2) AS pnl, round(avg(CAST(realized_pnl > 0 AS INT)), 6) AS hit_rate, round(avg(price), 6) AS avg_price FROM trades GROUP BY 1"),
)
def a48(spark, sf):
    out = R.trade_summary(roles.trades(spark, sf), ["decision_horizon"]).drop("avg_edge")
    return rounded(rounded(out, "hit_rate", "avg_price"), "pnl", digits=2)


# --- L2 ---------------------------------------------------------------------------

L2_SQL = """WITH e AS (SELECT CASE WHEN k > 24 THEN CASE WHEN k <= 48 THEN '24-48h' END WHEN k > 12 THEN '12-24h' WHEN k > 6 THEN '6-12h' WHEN k > 3 THEN '3-6h' WHEN k > 1 THEN '1-3h' WHEN k > 0 THEN '0-1h' END AS bucket, spread, raw_gap, after_cost_edge, event_id FROM opportunities),
    b AS (SELECT * FROM (VALUES ('0-1h'), ('1-3h'), ('3-6h'), ('6-12h'), ('12-24h'), ('24-48h')) v(bucket))
    SELECT b.bucket, count(event_id) AS count, round(list_sort(list(spread) FILTER (event_id IS NOT NULL))[len(list(spread) FILTER (event_id IS NOT NULL)) // 2 + 1], 8) AS median_spread,
    round(avg(raw_gap), 6) AS mean_bid_depth, round(avg(after_cost_edge), 6) AS mean_ask_depth, round(avg(CASE WHEN event_id IS NOT NULL THEN CAST(coalesce(spread, 1) < 0.1 AS INT) END) * 100, 6) AS tradeable_pct
    FROM b LEFT JOIN e USING (bucket) GROUP BY 1"""


@query("a23_l2_buckets", with_roles("opportunities", L2_SQL))
def a23(spark, sf):
    """Spread and depth by hours to settlement, upper median, empty buckets kept."""
    l2 = roles.opportunities(spark, sf).select(
        F.col("k").alias("hours_to_settlement"), "spread", F.col("raw_gap").alias("bid_depth"), F.col("after_cost_edge").alias("ask_depth")
    )
    return rounded(R.l2_buckets(l2), "median_spread", digits=8).transform(rounded, "mean_bid_depth", "mean_ask_depth", "tradeable_pct")


# --- errors -------------------------------------------------------------------------

ERR = """count(*) AS rows, round(avg(mean - y), 6) AS bias, round(avg(abs(mean - y)), 6) AS mae, round(sqrt(avg((mean - y) * (mean - y))), 6) AS rmse,
    round(quantile_cont(abs(mean - y), 0.95), 6) AS p95_abs_error, round(quantile_cont(abs(mean - y), 0.99), 6) AS p99_abs_error"""
ERR_COLS = ("bias", "mae", "rmse", "p95_abs_error", "p99_abs_error")


@query("a26_baseline_errors", with_roles("preds", f"SELECT {ERR} FROM preds"))
def a26(spark, sf):
    return rounded(R.error_summary(roles.preds(spark, sf), "mean", "y"), *ERR_COLS)


@query("a27_city_errors", with_roles("preds", f"SELECT city, {ERR} FROM preds GROUP BY city"))
def a27(spark, sf):
    return rounded(R.error_summary(roles.preds(spark, sf), "mean", "y", ["city"]), *ERR_COLS)


@query(
    "a27_macro_mae",
    with_roles("preds", "WITH c AS (SELECT avg(abs(mean - y)) AS mae FROM preds GROUP BY city) SELECT round(avg(mae), 6) AS macro_mae, count(*) AS group_count, round(min(mae), 6) AS min_mae, round(max(mae), 6) AS max_mae FROM c"),
)
def a27m(spark, sf):
    per = roles.preds(spark, sf).groupBy("city").agg(F.avg(F.abs(F.col("mean") - F.col("y"))).alias("mae"))
    return rounded(R.macro_mae(per), "macro_mae", "min_mae", "max_mae")


@query("o07_worst_cities", with_roles("preds", "SELECT city, round(avg(abs(mean - y)), 6) AS mae FROM preds GROUP BY city ORDER BY mae DESC, city LIMIT 10"))
def o07(spark, sf):
    per = roles.preds(spark, sf).groupBy("city").agg(F.round(F.avg(F.abs(F.col("mean") - F.col("y"))), 6).alias("mae"))
    return per.orderBy(F.desc("mae"), "city").limit(10)


@query(
    "a28_time_forward_folds",
    with_roles(
        "preds",
        f"""WITH d AS (SELECT target_date, row_number() OVER (ORDER BY target_date) - 1 AS ord, count(*) OVER () AS n FROM (SELECT DISTINCT target_date FROM preds)),
    f AS (SELECT target_date, CASE WHEN ord >= n * 4 // 5 THEN 4 WHEN ord >= n * 3 // 5 THEN 3 WHEN ord >= n * 2 // 5 THEN 2 WHEN ord >= n // 5 THEN 1 END AS fold FROM d)
    SELECT CAST(fold AS INT) AS fold, strftime(min(target_date), '%Y-%m-%d') AS start_date, strftime(max(target_date), '%Y-%m-%d') AS end_date, {ERR} FROM preds JOIN f USING (target_date) WHERE fold IS NOT NULL GROUP BY 1""",
    ),
)
def a28(spark, sf):
    """Errors per chronological fold of the distinct dates."""
    from skyledger.operators.folds import date_folds

    # read for the dates, the errors, each pass of their quantiles and the spans
    p = date_folds(written(roles.preds(spark, sf).select("target_date", "mean", "y"), "fold-rows"), "target_date", 4)
    err = R.error_summary(p, "mean", "y", ["fold"])
    span = p.groupBy("fold").agg(
        F.date_format(F.min("target_date"), "yyyy-MM-dd").alias("start_date"), F.date_format(F.max("target_date"), "yyyy-MM-dd").alias("end_date")
    )
    return rounded(err.join(span, "fold"), *ERR_COLS)


@query(
    "a45_city_tiers",
    with_roles("preds", "SELECT city, count(*) AS rows, CASE WHEN count(*) >= 2400 THEN 'primary' ELSE 'exploratory' END AS tier, round(least(1.0, 0.04 * (SELECT count(*) FROM preds) / count(*)), 6) AS weight FROM preds GROUP BY city"),
)
def a45(spark, sf):
    return R.city_tiers(roles.preds(spark, sf), "city", 2400, 0.04)


@query("a38_status_sums", "SELECT o_orderstatus AS status, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def a38(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "a40_weather_snapshot",
    "SELECT strftime(l_shipdate, '%Y-%m-%d') AS date, count(*) AS rows, count(DISTINCT l_suppkey) AS stations FROM lineitem GROUP BY 1",
)
def a40(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("date")).agg(
        F.count("*").alias("rows"), F.count_distinct("l_suppkey").alias("stations")
    )


@query(
    "a41_frame_signature",
    """WITH h AS (SELECT string_agg(concat_ws('=', o_orderpriority, n), ',' ORDER BY o_orderpriority) AS horizons FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)),
    f AS (SELECT count(*) AS rows, strftime(min(o_orderdate), '%Y-%m-%d') AS min_date, strftime(max(o_orderdate), '%Y-%m-%d') AS max_date, count(DISTINCT o_orderdate) AS dates, count(DISTINCT o_custkey) AS markets FROM orders)
    SELECT f.*, horizons, sha256(concat_ws('|', '6', rows, min_date, max_date, dates, markets, horizons)) AS signature FROM f, h""",
)
def a41(spark, sf):
    return R.frame_signature(table(spark, sf, "orders"), "o_orderdate", "o_custkey", "o_orderpriority")
