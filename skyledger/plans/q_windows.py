"""Folds, holdouts, islands, shards and queue queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import folds as D
from skyledger.operators import reports as R
from skyledger.operators import windows as W
from skyledger.plans import roles
from skyledger.plans.registry import query
from skyledger.plans.roles import with_roles
from skyledger.sources.tables import table


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


def split_frame(spark, sf):
    """Orders as split rows: market and target date, several rows per group."""
    return table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("market_id"),
        F.to_date("o_orderdate").alias("target_date"),
        F.col("l_shipdate").alias("decision_time_utc"),
        F.col("o_orderpriority").alias("decision_horizon"),
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
    )


FRAME = """fr AS (SELECT o_custkey AS market_id, CAST(o_orderdate AS DATE) AS target_date, l_shipdate AS decision_time_utc, o_orderpriority AS decision_horizon, l_orderkey, l_linenumber, l_extendedprice
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  g AS (SELECT market_id, target_date, min(decision_time_utc) AS t FROM fr GROUP BY ALL),
  o AS (SELECT market_id, target_date, row_number() OVER (ORDER BY target_date, t, market_id) - 1 AS ordinal, count(*) OVER () AS n FROM g)"""


@query("w17_group_ordinals", f"WITH {FRAME} SELECT market_id, strftime(target_date, '%Y-%m-%d') AS day, ordinal FROM o")
def w17(spark, sf):
    """Groups numbered by first appearance in chronological order."""
    out = D.group_ordinal(split_frame(spark, sf), ["market_id", "target_date"])
    return out.select("market_id", day("target_date").alias("day"), "ordinal")


@query(
    "o01_canonical_order",
    f"WITH {FRAME} SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY target_date, decision_time_utc, market_id, decision_horizon, l_orderkey, l_linenumber, l_extendedprice) - 1 AS ordinal FROM fr",
)
def o01(spark, sf):
    """Place of every row in the canonical order, found without a one-task sort."""
    f = split_frame(spark, sf)
    order = [*D.canonical_order(f), "l_orderkey", "l_linenumber", "l_extendedprice"]
    return D.global_ordinal(f, order).select("l_orderkey", "l_linenumber", "l_extendedprice", "ordinal")


@query(
    "w06_expanding_folds",
    f"""WITH {FRAME}, f AS (SELECT fr.*, ordinal, CASE WHEN ordinal >= 1000 THEN (ordinal - 1000) // 500 END AS fold FROM fr JOIN o USING (market_id, target_date)),
    c AS (SELECT fold, count(*) AS test_rows, min(ordinal) AS first_group FROM f GROUP BY 1)
    SELECT fold, test_rows, CAST((SELECT count(*) FROM f WHERE f.ordinal < 1000 + c.fold * 500) AS BIGINT) AS train_rows FROM c WHERE fold IS NOT NULL""",
)
def w06(spark, sf):
    """Train and test rows of every expanding market-day fold."""
    folded = D.expanding_folds(split_frame(spark, sf), ["market_id", "target_date"], 1000, 500)
    return D.fold_sizes(folded, 1000, 500)


@query(
    "w06_target_day_folds",
    """WITH fr AS (SELECT CAST(o_orderdate AS DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey), o AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS ordinal FROM (SELECT DISTINCT d FROM fr))
    SELECT (ordinal - 100) // 250 AS fold, count(*) AS test_rows, strftime(min(d), '%Y-%m-%d') AS first_day FROM fr JOIN o USING (d) WHERE ordinal >= 100 GROUP BY 1""",
)
def w06d(spark, sf):
    folded = D.expanding_folds(split_frame(spark, sf), ["target_date"], 100, 250).where(F.col("fold").isNotNull())
    return folded.groupBy("fold").agg(F.count("*").alias("test_rows"), day(F.min("target_date")).alias("first_day"))


@query(
    "w07_validation_folds",
    f"""WITH {FRAME}, s AS (SELECT *, greatest(n // 5, 1) AS size, greatest(16, greatest(n // 5, 1)) AS first FROM o), k AS (SELECT *, (ordinal - first) // size AS k FROM s WHERE ordinal >= first)
    SELECT k AS fold, count(*) AS groups, min(ordinal) AS first_ordinal FROM k WHERE first + (k + 1) * size <= n GROUP BY 1""",
)
def w07(spark, sf):
    """Expanding validation folds of a fifth of the groups each."""
    folded = D.validation_folds(split_frame(spark, sf), ["market_id", "target_date"], 4, 16).where(F.col("fold").isNotNull())
    groups = folded.select("fold", "ordinal").distinct()
    return groups.groupBy("fold").agg(F.count("*").alias("groups"), F.min("ordinal").alias("first_ordinal"))


@query(
    "w08_holdout",
    f"""WITH {FRAME} SELECT CASE WHEN ordinal >= least(greatest(CAST(floor(n * 0.8) AS BIGINT), 1), n - 1) THEN 'test' ELSE 'train' END AS role, count(*) AS rows, round(sum(l_extendedprice), 2) AS total FROM fr JOIN o USING (market_id, target_date) GROUP BY 1""",
)
def w08(spark, sf):
    """Last fifth of the market days as holdout."""
    marked = D.holdout(split_frame(spark, sf), ["market_id", "target_date"], 0.2)
    return marked.groupBy("role").agg(F.count("*").alias("rows"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query(
    "w09_recency_weights",
    "SELECT o_orderpriority, round(avg(least(greatest(exp(-ln(2) * date_diff('day', o_orderdate, (SELECT max(o_orderdate) FROM orders)) / 900), 0.2), 1)), 6) AS weight FROM orders GROUP BY 1",
)
def w09(spark, sf):
    """Half-life decay kept inside [0.2, 1]."""
    o = table(spark, sf, "orders")
    newest = o.agg(F.max("o_orderdate")).scalar()
    w = o.withColumn("newest", newest).withColumn("w", D.recency_weight(F.col("o_orderdate"), F.col("newest"), 900.0))
    return w.groupBy("o_orderpriority").agg(F.round(F.avg("w"), 6).alias("weight"))


@query(
    "w09_normalized_recency",
    """WITH a AS (SELECT o_orderpriority, CASE WHEN o_totalprice > 5000 THEN date_diff('day', o_orderdate, (SELECT max(o_orderdate) FROM orders WHERE o_totalprice > 5000)) END AS age FROM orders),
    w AS (SELECT o_orderpriority, exp(-ln(2) * coalesce(age, (SELECT median(age) FROM a)) / 900) AS w FROM a) SELECT o_orderpriority, round(avg(w) / (SELECT avg(w) FROM w), 6) AS weight FROM w GROUP BY 1""",
)
def w09n(spark, sf):
    """Decay scaled to mean 1; a row without a date takes the median age."""
    o = table(spark, sf, "orders").withColumn("d", F.when(F.col("o_totalprice") > 5000, F.col("o_orderdate")))
    w = D.normalized_recency(o, "d", 900.0)
    return w.groupBy("o_orderpriority").agg(F.round(F.avg("weight"), 6).alias("weight"))


@query(
    "f03_last_dates",
    "WITH c AS (SELECT * FROM orders WHERE o_orderdate >= DATE '1997-01-01'), d AS (SELECT DISTINCT o_orderdate FROM c ORDER BY 1 DESC LIMIT 30) SELECT o_orderkey FROM c WHERE o_orderdate IN (SELECT o_orderdate FROM d)",
)
def f03(spark, sf):
    """Date slice, then the last 30 distinct dates."""
    o = table(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp"))
    return D.last_dates(o, "o_orderdate", 30).select("o_orderkey")


@query("j09_last_groups", f"WITH {FRAME}, l AS (SELECT * FROM o ORDER BY ordinal DESC LIMIT 200) SELECT market_id, strftime(target_date, '%Y-%m-%d') AS day, count(*) AS rows FROM fr SEMI JOIN l USING (market_id, target_date) GROUP BY ALL")
def j09(spark, sf):
    """Rows of the last 200 test groups."""
    out = D.last_groups(split_frame(spark, sf), ["market_id", "target_date"], 200)
    return out.groupBy("market_id", day("target_date").alias("day")).agg(F.count("*").alias("rows"))


ISLANDS = """d AS (SELECT DISTINCT l_suppkey, CAST(l_shipdate AS DATE) AS d FROM lineitem), i AS (SELECT l_suppkey, d, d - CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY d) AS INT) AS i FROM d)"""


@query("w12_date_ranges", f"WITH {ISLANDS} SELECT l_suppkey, strftime(min(d), '%Y-%m-%d') AS start_date, strftime(max(d), '%Y-%m-%d') AS end_date, count(*) AS days FROM i GROUP BY l_suppkey, i")
def w12(spark, sf):
    """Consecutive ship dates per supplier."""
    out = W.date_ranges(table(spark, sf, "lineitem"), ["l_suppkey"], "l_shipdate")
    return out.select("l_suppkey", day("start_date").alias("start_date"), day("end_date").alias("end_date"), "days")


@query(
    "w12_count_ranges",
    """WITH d AS (SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY ALL), i AS (SELECT *, d - CAST(row_number() OVER (PARTITION BY o_orderstatus, n ORDER BY d) AS INT) AS i FROM d)
    SELECT o_orderstatus, n AS count, strftime(min(d), '%Y-%m-%d') AS start_date, strftime(max(d), '%Y-%m-%d') AS end_date FROM i GROUP BY o_orderstatus, n, i""",
)
def w12c(spark, sf):
    """Consecutive dates with the same number of orders."""
    out = W.count_ranges(table(spark, sf, "orders"), ["o_orderstatus"], "o_orderdate")
    return out.select("o_orderstatus", "count", day("start_date").alias("start_date"), day("end_date").alias("end_date"))


@query(
    "w13_first_incomplete",
    """WITH d AS (SELECT CAST(ts AS DATE) AS d, count(DISTINCT event_type) AS n FROM events GROUP BY 1), r AS (SELECT d FROM d WHERE d >= DATE '2024-01-05' AND n = 5)
    SELECT strftime(coalesce(max(d) + 1, DATE '2024-01-05'), '%Y-%m-%d') AS next_date FROM (SELECT d, date_diff('day', DATE '2024-01-05', d) - row_number() OVER (ORDER BY d) + 1 AS i FROM r) WHERE i = 0""",
)
def w13(spark, sf):
    """First day from an anchor whose event types are not all present."""
    out = W.first_incomplete_date(table(spark, sf, "events"), "ts", "event_type", "2024-01-05", F.lit(5))
    return out.select(day("next_date").alias("next_date"))


@query("w18_bucket_edges", "SELECT DISTINCT p_size AS upper, coalesce(lead(p_size) OVER (ORDER BY p_size DESC), 0) AS lower FROM (SELECT DISTINCT p_size FROM part)")
def w18(spark, sf):
    """Lower edge of every bucket from the next smaller one."""
    b = table(spark, sf, "part").select(F.col("p_size").alias("upper")).distinct()
    return W.bucket_edges(b, "upper")


@query(
    "w22_latest_log_entry",
    "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1",
)
def w22(spark, sf):
    return W.latest_entry(table(spark, sf, "events"), ["user_id"], "event_type", ["error", "signup"], ["ts", "event_id"], ["event_id"])


@query(
    "w22_retry_dates",
    """WITH r AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS a, CASE WHEN o_totalprice > 250000 THEN CAST(o_orderdate AS DATE) + 2 ELSE CAST(o_orderdate AS DATE) END AS b FROM orders WHERE o_orderstatus = 'P')
    SELECT o_custkey, strftime(unnest(generate_series(a, b, INTERVAL 1 DAY)), '%Y-%m-%d') AS date FROM r""",
)
def w22d(spark, sf):
    """Retry ranges written as text expanded to single dates."""
    o = table(spark, sf, "orders").where(F.col("o_orderstatus") == "P")
    a, b = day("o_orderdate"), day(F.date_add("o_orderdate", 2))
    text = F.when(F.col("o_totalprice") > 250000, F.concat(F.lit("retry "), a, F.lit(".."), b)).otherwise(F.concat(F.lit("retry "), a))
    out = W.dates_of_ranges(o.select("o_custkey", text.alias("range_text")), "range_text")
    return out.select("o_custkey", day("date").alias("date"))


@query("i19_work_list", "SELECT s_suppkey, strftime(d, '%Y-%m-%d') AS work_date FROM (SELECT DISTINCT s_suppkey FROM supplier), (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS d)")
def i19(spark, sf):
    """Every station with every date."""
    out = W.work_list(table(spark, sf, "supplier"), "s_suppkey", "2024-01-01", "2024-01-31")
    return out.select("s_suppkey", day("work_date").alias("work_date"))


@query(
    "t10_consecutive_failures",
    """WITH p AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
    SELECT user_id, epoch_us(min(ts)) AS cancelled_us, count(*) AS repeats FROM p WHERE event_type = 'error' AND prev = 'error' GROUP BY 1""",
)
def t10(spark, sf):
    """Workers with two failures in a row, and when the second came."""
    out = W.consecutive_failures(table(spark, sf, "events"), ["user_id"], "ts", "event_type", "error", ["event_id"])
    return out.select("user_id", F.unix_micros("cancelled_at").alias("cancelled_us"), "repeats")


@query(
    "a54_shard",
    with_roles("cities", """WITH o AS (SELECT orders.*, city, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders JOIN cities ON o_custkey = c_custkey), s AS (SELECT * FROM o WHERE i >= 5000 AND i < 5300)
    SELECT min(i) AS offset_start, max(i) AS offset_end, count(*) AS selected_markets, strftime(min(o_orderdate), '%Y-%m-%d') AS date_from, strftime(max(o_orderdate), '%Y-%m-%d') AS date_to, (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT city AS c FROM s)) AS cities FROM s"""),
)
def a54(spark, sf):
    """Positions 5000 to 5299 of the ordered markets."""
    o = table(spark, sf, "orders").join(roles.cities(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    out = W.describe_shard(W.shard(o, ["o_orderdate", "o_orderkey"], 5000, 300), "city", "o_orderdate")
    return out.withColumn("date_from", day("date_from")).withColumn("date_to", day("date_to"))


@query(
    "a55_job_progress",
    """WITH l AS (SELECT ts, event_id, CASE event_type WHEN 'click' THEN 'backfill_forecasts checkpoint' WHEN 'error' THEN 'fetch error' ELSE 'other' END AS message, CASE WHEN event_type = 'error' THEN 'k' || CAST(json_extract_string(props, '$.k') AS VARCHAR) END AS error,
    event_id AS processed, 20000 AS total, CAST(json_extract_string(props, '$.k') AS BIGINT) AS ok FROM events)
    SELECT max(processed) FILTER (message LIKE 'backfill%') AS processed, arg_max(error, (ts, event_id)) FILTER (message = 'fetch error') AS last_error, max(ok) AS single_run_ok, round(100.0 * max(processed) FILTER (message LIKE 'backfill%') / 20000, 2)::DOUBLE AS pct FROM l""",
)
def a55(spark, sf):
    """Greatest counters and the last error of a job log."""
    t = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("bigint")
    log = table(spark, sf, "events").select(
        "ts", "event_id",
        F.when(t == "click", "backfill_forecasts checkpoint").when(t == "error", "fetch error").otherwise("other").alias("message"),
        F.lit("INFO").alias("level"),
        F.when(t == "error", F.concat(F.lit("k"), k.cast("string"))).alias("error"),
        F.col("event_id").alias("processed"), F.lit(20000).alias("total"), k.alias("ok"), F.lit(0).alias("err"),
    )
    return W.job_progress(log, ["ts", "event_id"]).select("processed", "last_error", "single_run_ok", "pct")


@query(
    "a56_dashboard_overview",
    with_roles("opportunities", """SELECT count(*) FILTER (reason = 'tradable') AS opportunity_tradable_count, count(*) FILTER (reason = 'tradable' AND k < 60) AS observation_tradable_count,
    count(*) FILTER (reason = 'tradable' AND k < 60 OR k < 80) AS queue_size, count(*) FILTER (NOT (reason = 'tradable' AND k < 60) AND k < 80) AS manual_review_count, count(*) FILTER (k <= 24) AS open_phase_count FROM opportunities"""),
)
def a56(spark, sf):
    """Head counts over the four logs."""
    from skyledger.plans.q_reports import observation_log

    o = roles.opportunities(spark, sf)
    obs = observation_log(spark, sf)
    queue = obs.where(F.col("queue_state").isin("tradable", "manual_review"))
    return W.dashboard_overview(o, obs, queue, o.where(F.col("k") <= 24))


COMBO = """SELECT city || '/' || decision_horizon AS combo, count(*) FILTER (reason = 'tradable' AND k > 50) AS fills, count(*) FILTER (reason = 'tradable') AS tradable_rows, count(*) FILTER (raw_gap > 0) AS raw_gap_positive_count,
    count(*) FILTER (after_cost_edge > 0) AS after_cost_edge_positive_count, count(*) FILTER (reason = 'fee_killed_edge') AS fee_killed_edge, count(*) FILTER (reason = 'raw_gap_non_positive') AS raw_gap_non_positive, count(*) FILTER (reason = 'policy_filtered') AS policy_filtered
    FROM opportunities GROUP BY 1"""


def combos(spark, sf):
    return roles.opportunities(spark, sf).withColumn("combo", F.concat_ws("/", "city", "decision_horizon")).withColumn(
        "fill", F.when((F.col("reason") == "tradable") & (F.col("k") > 50), F.col("k"))
    )


@query(
    "a47_combo_leaderboard",
    with_roles("opportunities", f"{COMBO} ORDER BY fills DESC, tradable_rows DESC, after_cost_edge_positive_count DESC, raw_gap_positive_count DESC, raw_gap_non_positive, policy_filtered, combo LIMIT 10"),
)
def a47(spark, sf):
    return W.combo_leaderboard(combos(spark, sf), "combo")


@query(
    "o09_watchlist_model",
    with_roles("opportunities", f"WITH c AS ({COMBO}) SELECT combo, fee_killed_edge FROM c ORDER BY fee_killed_edge DESC, raw_gap_positive_count DESC, raw_gap_non_positive, combo LIMIT 1"),
)
def o09(spark, sf):
    return W.fee_watchlist_model(W.combo_leaderboard(combos(spark, sf), "combo", None), "combo").select("combo", "fee_killed_edge")


@query(
    "o10_watchlist_examples",
    with_roles("opportunities", """WITH f AS (SELECT *, spread AS best_ask, round(greatest(spread + after_cost_edge, 0), 6) AS watch_rule_threshold_ask FROM opportunities WHERE reason = 'fee_killed_edge' AND spread <> 0 AND after_cost_edge IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY market_id, decision_horizon ORDER BY event_id) = 1)
    SELECT city, market_id, decision_horizon, event_id, watch_rule_threshold_ask FROM f ORDER BY city, decision_horizon, event_id LIMIT 20"""),
)
def o10(spark, sf):
    """Break-even asks of fee-killed outcomes, first per key."""
    o = roles.opportunities(spark, sf).withColumn("best_ask", F.col("spread"))
    out = W.watchlist_examples(o, ["market_id", "decision_horizon"], [F.asc("event_id")], ["city", "decision_horizon", "event_id"], 20)
    return out.select("city", "market_id", "decision_horizon", "event_id", "watch_rule_threshold_ask")


@query(
    "a53_dataset_ranges",
    with_roles("preds", "SELECT city, count(DISTINCT target_date) AS dates, strftime(min(target_date), '%Y-%m-%d') AS first_date, strftime(max(target_date), '%Y-%m-%d') AS last_date FROM preds GROUP BY 1"),
)
def a53(spark, sf):
    return roles.preds(spark, sf).groupBy("city").agg(
        F.count_distinct("target_date").alias("dates"), day(F.min("target_date")).alias("first_date"), day(F.max("target_date")).alias("last_date")
    )


@query("a53_split_count", f"WITH {FRAME} SELECT count(*) AS groups, least(count(*) - 1, 400) AS splits FROM o")
def a53s(spark, sf):
    return W.split_count(split_frame(spark, sf), ["market_id", "target_date"], 400)


@query(
    "q08_batch_outcomes",
    """WITH b AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS hard, count(*) FILTER (o_orderstatus <> 'P') AS done, count(*) FILTER (o_orderstatus = 'P' AND o_totalprice > 100000) AS retry, CASE WHEN sum(o_totalprice) > 4000000 THEN 'limit' END AS stop FROM orders GROUP BY 1)
    SELECT o_custkey, CASE WHEN n = 0 OR hard = 0 THEN 'success' WHEN done > 0 THEN 'partial' ELSE 'retry-only' END AS recovery,
    CASE WHEN stop IS NOT NULL THEN 'rate-limit-cancelled' WHEN hard = 0 THEN 'success' WHEN done > 0 THEN 'partial' WHEN n > 0 AND retry = n THEN 'retry-only' ELSE 'interrupted' END AS collection FROM b""",
)
def q08(spark, sf):
    """Outcome of every batch, by both ladders."""
    s = F.col("o_orderstatus")
    b = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), R.count_if(s == "P").alias("hard"), R.count_if(s != "P").alias("done"),
        R.count_if((s == "P") & (F.col("o_totalprice") > 100000)).alias("retry"),
        F.when(F.sum("o_totalprice") > 4000000, "limit").alias("stop"),
    )
    return b.select(
        "o_custkey",
        W.recovery_outcome(F.col("n"), F.col("hard"), F.col("done")).alias("recovery"),
        W.collection_outcome(F.col("stop"), F.col("hard"), F.col("done"), F.col("n"), F.col("retry")).alias("collection"),
    )
