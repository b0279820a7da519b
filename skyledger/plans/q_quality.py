"""Data-quality queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import quality as Q
from skyledger.plans import roles
from skyledger.plans.registry import query
from skyledger.plans.roles import with_roles
from skyledger.sources.tables import table


@query("q01_row_floors", "SELECT 'customer' AS table_name, count(*) >= 150 AS ok FROM customer UNION ALL SELECT 'region', count(*) >= 100 FROM region")
def q01(spark, sf):
    """Row counts against floors in one job."""
    from skyledger.operators.merge import validate_tables

    tables = {t: table(spark, sf, t) for t in ("customer", "region")}
    out = validate_tables(tables, {"customer": ["c_custkey"], "region": ["r_regionkey"]}, {"customer": 150, "region": 100})
    return out.select("table_name", (F.col("status") != "below_floor").alias("ok"))


@query("q02_full_duplicates", "SELECT count(*) - count(DISTINCT (o_custkey, o_orderstatus, o_orderpriority)) AS duplicate_rows FROM orders")
def q02(spark, sf):
    return Q.full_duplicates(table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"))


CHECK_SQL = """h AS (SELECT market_id, decision_horizon, issue_time_utc, forecast_ts, CASE endpoint_kind WHEN 'fixture' THEN 'research_public' ELSE 'exact_public' END AS truth_track, temperature_2m, wind_speed_10m FROM hourly),
  f AS (SELECT count(*) AS n, count(*) FILTER (decision_horizon IS NULL) + count(*) FILTER (issue_time_utc IS NULL) + count(*) FILTER (temperature_2m IS NULL) AS nulls,
    count(*) FILTER (issue_time_utc IS NULL OR forecast_ts IS NULL OR issue_time_utc > forecast_ts) AS ord, count(*) FILTER (truth_track = 'research_public') AS rp, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM h)) AS dup FROM h),
  m AS (SELECT count(*) FILTER (k <> 3) AS bad FROM (SELECT count(DISTINCT decision_horizon) AS k FROM h GROUP BY market_id)),
  checks AS (SELECT unnest([{'check': 'non_empty', 'bad': 0, 'value': n, 'level': 'fail'}, {'check': 'duplicate_rows', 'bad': dup, 'value': dup, 'level': 'fail'}, {'check': 'null_cells', 'bad': nulls, 'value': nulls, 'level': 'warn'},
    {'check': 'three_horizons_per_market', 'bad': bad, 'value': bad, 'level': 'warn'}, {'check': 'issue_time_not_after_decision_time', 'bad': ord, 'value': ord, 'level': 'fail'},
    {'check': 'no_obvious_leaky_feature_names', 'bad': 0, 'value': 0, 'level': 'fail'}, {'check': 'no_constant_numeric_features', 'bad': 0, 'value': 0, 'level': 'warn'},
    {'check': 'truth_tier_explicit', 'bad': 0, 'value': 0, 'level': 'warn'}, {'check': 'exact_truth_coverage', 'bad': rp, 'value': rp, 'level': 'warn'}]) AS c FROM f, m)"""


def checks(spark, sf):
    h = roles.hourly(spark, sf).withColumn("truth_track", F.when(F.col("endpoint_kind") == "fixture", "research_public").otherwise("exact_public"))
    h = h.select("market_id", "decision_horizon", "issue_time_utc", "forecast_ts", "truth_track", "temperature_2m", "wind_speed_10m")
    return Q.dataset_checks(h, "market_id", "decision_horizon", "issue_time_utc", "forecast_ts", "truth_track", ["temperature_2m", "wind_speed_10m"])


@query("q03_dataset_checks", with_roles("hourly", f"WITH {CHECK_SQL} SELECT c.check AS check, CASE WHEN c.bad = 0 THEN 'pass' ELSE c.level END AS status, c.value AS value FROM checks"))
def q03(spark, sf):
    """Check table of a training set."""
    return checks(spark, sf)


@query(
    "s32_quality_score",
    with_roles("hourly", f"""WITH {CHECK_SQL}, s AS (SELECT count(*) FILTER (c.bad > 0 AND c.level = 'fail') AS fails, count(*) FILTER (c.bad > 0 AND c.level = 'warn') AS warns FROM checks)
    SELECT fails, warns, greatest(round(10.0 - fails - 0.25 * warns - 0.75 - 0.12, 2), 0)::DOUBLE AS score_10pt, CASE WHEN 10.0 - fails - 0.25 * warns - 0.87 >= 7 THEN 'research-grade' ELSE 'needs-repair' END AS grade FROM s"""),
)
def s32(spark, sf):
    return Q.quality_score(checks(spark, sf), F.lit(0.5), F.lit(12))


DIRTY = """d AS (SELECT 'forecasts.endpoint_kind_fixture' AS finding, count(*) FILTER (endpoint_kind = 'fixture') AS rows FROM hourly UNION ALL SELECT 'orders.synthetic_market_id', (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'orders.status_fixture', (SELECT count(*) FROM orders WHERE o_orderpriority = '5-LOW'))"""


def dirty(spark, sf):
    o = table(spark, sf, "orders")
    tagged = o.select(
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("synthetic_"), "o_orderkey")).otherwise(F.col("o_orderkey").cast("string")).alias("market_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", "demo_fixture").otherwise("ok").alias("status"),
    )
    clean = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("market_id"))
    return Q.contamination({"forecasts": roles.hourly(spark, sf), "orders": tagged, "customers": clean})


@query("f11_contamination", with_roles("hourly", f"WITH {DIRTY} SELECT finding, rows FROM d WHERE rows > 0"))
def f11(spark, sf):
    """Synthetic and fixture rows per table, findings only."""
    return dirty(spark, sf)


@query(
    "q07_trust_report",
    with_roles("hourly", f"WITH {DIRTY} SELECT 'warehouse_contamination' AS check, finding || '=' || rows AS detail FROM d WHERE rows > 0 UNION ALL SELECT 'workspace_inventory_match', 'synthetic' UNION ALL SELECT 'synthetic_inventory_forbidden', 'synthetic'"),
)
def q07(spark, sf):
    return Q.trust_report(dirty(spark, sf), "real_market", "synthetic")


@query(
    "q04_inventory_issues",
    """WITH i AS (SELECT o_orderkey, CASE WHEN o_totalprice < 20000 THEN 'example-' || o_orderkey ELSE 'm' || o_custkey END AS market, CASE WHEN o_orderpriority = '5-LOW' THEN 'bad' END AS perr, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN n_name END AS city, c_mktsegment AS spec, CASE WHEN o_orderstatus = 'P' THEN 'other' WHEN o_totalprice > 490000 THEN NULL ELSE c_mktsegment END AS re
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    s AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY o_orderkey) AS rn, n_sup FROM (SELECT *, city < 'NATION_3' AS n_sup FROM i)),
    r AS (SELECT o_orderkey, unnest(list_filter([CASE WHEN rn > 1 THEN 'duplicate_market_id' END, CASE WHEN rn = 1 AND market LIKE 'example-%' THEN 'example_market_id' END, CASE WHEN rn = 1 AND perr IS NOT NULL THEN 'parse_error' END,
      CASE WHEN rn = 1 AND perr IS NULL AND city IS NULL THEN 'missing_spec' END, CASE WHEN rn = 1 AND perr IS NULL AND city IS NOT NULL AND NOT n_sup THEN 'unsupported_city' END, CASE WHEN rn = 1 AND perr IS NULL AND city IS NOT NULL AND re IS NULL THEN 'reparse_failed' END,
      CASE WHEN rn = 1 AND perr IS NULL AND city IS NOT NULL AND re <> spec THEN 'spec_mismatch' END], lambda x: x IS NOT NULL)) AS reason FROM s) SELECT o_orderkey, reason FROM r""",
)
def q04(spark, sf):
    """Issues of a curated inventory."""
    o = table(spark, sf, "orders").join(roles.cities(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("ck"), "c_mktsegment"), F.col("o_custkey") == F.col("ck"))
    i = o.select(
        "o_orderkey",
        F.when(F.col("o_totalprice") < 20000, F.concat(F.lit("example-"), "o_orderkey")).otherwise(F.concat(F.lit("m"), "o_custkey")).alias("market"),
        F.when(F.col("o_orderpriority") == "5-LOW", "bad").alias("parse_error"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("city")).alias("city"),
        F.col("c_mktsegment").alias("spec_hash"),
        F.when(F.col("o_orderstatus") == "P", "other").when(F.col("o_totalprice") <= 490000, F.col("c_mktsegment")).alias("reparsed_hash"),
    )
    names = [f"NATION_{k}" for k in range(25) if f"NATION_{k}" < "NATION_3"]
    return Q.inventory_issues(i, "market", ["o_orderkey"], names).select("o_orderkey", "reason")


@query(
    "q05_collection_status",
    """WITH e AS (SELECT o_orderkey, o_custkey || '/' || o_orderpriority AS url, 'm' || o_custkey AS market, CASE WHEN o_totalprice < 10000 THEN 'timeout' END AS ferr, o_totalprice >= 15000 AS html, CASE WHEN o_totalprice < 20000 THEN 'Unsupported official source' WHEN o_totalprice < 25000 THEN 'bad json' END AS perr,
      n_name AS city, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_totalprice > 480000 THEN 0 ELSE 3 END AS comps, CASE WHEN o_totalprice > 450000 THEN 2 ELSE 3 END AS closed, CASE o_orderstatus WHEN 'P' THEN 'truth_source_lag' ELSE 'ready' END AS ts, CASE o_orderstatus WHEN 'P' THEN 'archive' END AS td, c_acctbal < 0 AS known
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    u AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY o_orderkey) AS rn FROM e),
    v AS (SELECT *, CASE WHEN rn > 1 THEN 'duplicate' WHEN ferr IS NOT NULL OR NOT html THEN 'parse_failed' WHEN perr LIKE 'Unsupported%' THEN 'unsupported_rule' WHEN perr IS NOT NULL THEN 'parse_failed' WHEN city >= 'NATION_5' THEN 'unsupported_rule' WHEN d >= DATE '2001-01-01' THEN 'not_historical'
      WHEN comps <= 0 THEN 'parse_failed' WHEN closed < comps THEN 'not_closed' WHEN known THEN 'duplicate' WHEN ts <> 'ready' THEN ts ELSE 'collected' END AS st,
      CASE WHEN rn > 1 THEN 'duplicate_url' WHEN ferr IS NOT NULL THEN ferr WHEN NOT html THEN 'missing_event_html' WHEN perr IS NOT NULL THEN perr WHEN city >= 'NATION_5' THEN 'unsupported_city' WHEN d >= DATE '2001-01-01' THEN 'not_historical' WHEN comps <= 0 THEN 'missing_component_markets' WHEN closed < comps THEN 'not_closed' WHEN known THEN 'duplicate_market_id' WHEN ts <> 'ready' THEN td END AS de FROM u),
    w AS (SELECT *, count(*) FILTER (st = 'collected') OVER (PARTITION BY market) AS n FROM v)
    SELECT o_orderkey, CASE WHEN st = 'collected' AND n > 1 THEN 'duplicate' ELSE st END AS status, CASE WHEN st = 'collected' AND n > 1 THEN 'duplicate_market_id' ELSE de END AS detail FROM w""",
)
def q05(spark, sf):
    """Status ladder of fetched events."""
    o = table(spark, sf, "orders").join(roles.cities(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("ck"), "c_acctbal"), F.col("o_custkey") == F.col("ck"))
    t = F.col("o_totalprice")
    e = o.select(
        "o_orderkey",
        F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority").alias("url"),
        F.concat(F.lit("m"), "o_custkey").alias("market"),
        F.when(t < 10000, "timeout").alias("fetch_error"),
        (t >= 15000).alias("has_html"),
        F.when(t < 20000, "Unsupported official source").when(t < 25000, "bad json").alias("parse_error"),
        "city",
        F.to_date("o_orderdate").alias("target_date"),
        F.when(t > 480000, 0).otherwise(3).alias("components"),
        F.when(t > 450000, 2).otherwise(3).alias("closed_components"),
        F.when(F.col("o_orderstatus") == "P", "truth_source_lag").otherwise("ready").alias("truth_status"),
        F.when(F.col("o_orderstatus") == "P", "archive").alias("truth_detail"),
        (F.col("c_acctbal") < 0).alias("known"),
    )
    names = [f"NATION_{k}" for k in range(25) if f"NATION_{k}" < "NATION_5"]
    out = Q.collection_status(e, "url", "market", ["o_orderkey"], names, F.lit("2001-01-01").cast("date"))
    return out.select("o_orderkey", "status", "detail")
