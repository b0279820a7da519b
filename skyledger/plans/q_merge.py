"""Keyed table maintenance, set operations and key filters over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import merge as M
from skyledger.plans import roles
from skyledger.plans.registry import query
from skyledger.plans.roles import with_roles
from skyledger.session import scratch_path
from skyledger.sources.tables import export_query, replace_table, table
from skyledger.sources.versions import read_current


@query(
    "k01_upsert",
    """WITH target AS (SELECT o_custkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS pr, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'),
    inc AS (SELECT o_custkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS pr, o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'),
    stage AS (SELECT * FROM inc QUALIFY row_number() OVER (PARTITION BY o_custkey, pr ORDER BY o_orderkey DESC) = 1)
    SELECT o_custkey, pr, o_orderkey, o_totalprice, NULL AS o_orderstatus FROM target t WHERE NOT EXISTS (SELECT 1 FROM stage s WHERE s.o_custkey IS NOT DISTINCT FROM t.o_custkey AND s.pr IS NOT DISTINCT FROM t.pr)
    UNION ALL SELECT o_custkey, pr, o_orderkey, NULL, o_orderstatus FROM stage""",
)
def k01(spark, sf):
    """Merge with null-safe keys and a new column."""
    o = table(spark, sf, "orders").withColumn("pr", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))
    target = o.where(F.col("o_orderstatus") == "F").select("o_custkey", "pr", "o_orderkey", "o_totalprice")
    incoming = o.where(F.col("o_orderstatus") == "O").select("o_custkey", "pr", "o_orderkey", "o_orderstatus")
    return M.upsert(target, incoming, ["o_custkey", "pr"], ["o_orderkey"])


@query(
    "k02_keep_last",
    "SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY CASE WHEN o_totalprice > 400000 THEN NULL ELSE o_orderdate END DESC NULLS FIRST, o_orderkey DESC) = 1",
)
def k02(spark, sf):
    """Latest row per key; a null time counts as latest."""
    o = table(spark, sf, "orders").withColumn("t", F.when(F.col("o_totalprice") > 400000, None).otherwise(F.col("o_orderdate")))
    return M.keep_last(o, ["o_custkey", "o_orderpriority"], ["t", "o_orderkey"]).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("w01_latest_rows", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def w01(spark, sf):
    return M.keep_last(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("w02_latest_by_tail", "SELECT conv_id, max(turn) AS turn, length(arg_max(text, turn)) AS n_chars FROM conversations GROUP BY 1")
def w02(spark, sf):
    """Last turn of every conversation."""
    out = M.keep_last(table(spark, sf, "conversations"), ["conv_id"], ["turn"])
    return out.select("conv_id", "turn", F.length("text").cast("bigint").alias("n_chars"))


@query("j04_panel_lookup", with_roles("panel", "SELECT market_id, decision_horizon, token_id, decision_id, coverage_status FROM panel QUALIFY row_number() OVER (PARTITION BY market_id, decision_horizon, token_id ORDER BY decision_ts DESC, decision_id DESC) = 1"))
def j04(spark, sf):
    """Last panel row per market, horizon and token."""
    out = M.keep_last(roles.panel(spark, sf), ["market_id", "decision_horizon", "token_id"], ["decision_ts", "decision_id"])
    return out.select("market_id", "decision_horizon", "token_id", "decision_id", "coverage_status")


@query("w20_last_of_block", "SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL")
def w20(spark, sf):
    """One row of every duplicate block, the last by price."""
    return M.keep_last(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "j08_missing_only",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')",
)
def j08(spark, sf):
    """Work keys not done yet."""
    done = table(spark, sf, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"))
    return M.missing_only(table(spark, sf, "customer").select("c_custkey"), done.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("f01_id_filter", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def f01(spark, sf):
    """Rows of an id set held as a table."""
    ids = table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return M.only_in(table(spark, sf, "orders"), ids, ["o_custkey"]).select("o_orderkey")


@query("f02_keyed_scan", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def f02(spark, sf):
    ids = table(spark, sf, "supplier").where(F.col("s_acctbal") > 5000).select(F.col("s_suppkey").alias("l_suppkey"))
    return M.only_in(table(spark, sf, "lineitem"), ids, ["l_suppkey"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query(
    "f12_negative_cache",
    """WITH neg AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice < 50000)
    SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM neg)""",
)
def f12(spark, sf):
    """Requests not known to be unavailable."""
    bad = table(spark, sf, "orders").where((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 50000))
    return M.missing_only(table(spark, sf, "customer").select("c_custkey"), bad.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query(
    "k09_append_new",
    """WITH log AS (SELECT user_id, event_type, event_id FROM events WHERE ts < TIMESTAMP '2024-01-10'), b AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL)
    SELECT * FROM log UNION ALL SELECT * FROM b WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM log)""",
)
def k09(spark, sf):
    """Append only unseen keys; the first of a batch wins."""
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts")
    cut = F.lit("2024-01-10").cast("timestamp")
    old, new = e.where(F.col("ts") < cut).drop("ts"), e.where(F.col("ts") >= cut).drop("ts")
    return M.append_new(old, new, ["user_id", "event_type"], [F.asc("event_id")])


@query(
    "k10_leaderboard_union",
    "SELECT name, arg_min(bal, src) AS bal, min(src) AS src FROM (SELECT s_nationkey AS name, max(s_acctbal) AS bal, 1 AS src FROM supplier GROUP BY 1 UNION ALL SELECT c_nationkey, max(c_acctbal), 2 FROM customer GROUP BY 1) GROUP BY 1",
)
def k10(spark, sf):
    """Union of leaderboards, the first file wins."""
    a = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("name")).agg(F.max("s_acctbal").alias("bal")).withColumn("src", F.lit(1))
    b = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("name")).agg(F.max("c_acctbal").alias("bal")).withColumn("src", F.lit(2))
    return M.keep_first(M.union_by_name(a, b), ["name"], [F.asc("src")])


@query(
    "k06_merge_by_precedence",
    """SELECT key, arg_max(bal, p) AS bal, max(p) AS source_priority, arg_max(kind, p) AS kind FROM (SELECT c_nationkey AS key, max(c_acctbal) AS bal, 10 AS p, 'full' AS kind FROM customer GROUP BY 1
    UNION ALL SELECT s_nationkey, max(s_acctbal), 20, 'probe' FROM supplier WHERE s_acctbal > 4000 GROUP BY 1) GROUP BY 1""",
)
def k06(spark, sf):
    """Later-ranked sources win; a missing key column is filled."""
    a = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.max("c_acctbal").alias("bal")).withColumn("kind", F.lit("full"))
    b = table(spark, sf, "supplier").where(F.col("s_acctbal") > 4000).groupBy(F.col("s_nationkey").alias("key")).agg(F.max("s_acctbal").alias("bal")).withColumn("kind", F.lit("probe"))
    return M.merge_by_precedence([(10, a), (20, b)], ["key"])


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@query("k05_manifest", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in TABLES))
def k05(spark, sf):
    """Row counts of every table in one job."""
    return M.inventory({t: table(spark, sf, t) for t in TABLES}).select("table_name", "rows")


@query("k11_source_inventory", "SELECT * FROM (SELECT 'party' AS target_table, greatest((SELECT count(*) FROM customer), (SELECT count(*) FROM supplier)) AS max_rows UNION ALL SELECT 'trade', greatest((SELECT count(*) FROM orders), (SELECT count(*) FROM lineitem)))")
def k11(spark, sf):
    src = [("a", "party", table(spark, sf, "customer")), ("b", "party", table(spark, sf, "supplier")), ("a", "trade", table(spark, sf, "orders")), ("b", "trade", table(spark, sf, "lineitem"))]
    return M.source_inventory(src).select("target_table", "max_rows")


@query(
    "k07_validate_tables",
    """SELECT 'orders' AS table_name, count(*) AS rows, count(*) - count(DISTINCT o_orderkey) AS duplicates, CASE WHEN count(*) < 100 THEN 'below_floor' WHEN count(*) > count(DISTINCT o_orderkey) THEN 'duplicates' ELSE 'ok' END AS status FROM orders
    UNION ALL SELECT 'lineitem', count(*), count(*) - count(DISTINCT (l_orderkey, l_linenumber)), CASE WHEN count(*) > count(DISTINCT (l_orderkey, l_linenumber)) THEN 'duplicates' ELSE 'ok' END FROM lineitem
    UNION ALL SELECT 'region', count(*), 0, 'below_floor' FROM region""",
)
def k07(spark, sf):
    tables = {t: table(spark, sf, t) for t in ("orders", "lineitem", "region")}
    keys = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "region": ["r_regionkey"]}
    return M.validate_tables(tables, keys, {"orders": 100, "region": 50}).drop("floor")


@query("u06_duplicate_count", "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem")
def u06(spark, sf):
    return M.duplicate_count(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("k04_zero_fill", with_roles("hourly", "SELECT model_name, endpoint_kind, decision_horizon, round(sum(coalesce(temperature_2m, 0)), 4) AS t, count(coalesce(temperature_2m, 0)) AS n FROM hourly GROUP BY ALL"))
def k04(spark, sf):
    """Null numbers become 0, null texts stay."""
    h = M.zero_fill(roles.hourly(spark, sf))
    return h.groupBy("model_name", "endpoint_kind", "decision_horizon").agg(F.round(F.sum("temperature_2m"), 4).alias("t"), F.count("temperature_2m").alias("n"))


@query("k08_run_ledger", "SELECT o_orderkey, substr(sha256(concat_ws('|', o_orderpriority, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d'))), 1, 16) AS run_id, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'running' END AS status FROM orders")
def k08(spark, sf):
    """Run ids and statuses; finished runs replace running ones by key."""
    o = table(spark, sf, "orders").withColumn("at", F.date_format("o_orderdate", "yyyy-MM-dd"))
    runs = o.withColumn("run_id", M.run_id(F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("at")))
    started = runs.select("o_orderkey", "run_id", F.lit("running").alias("status"), F.lit(0).alias("seq"))
    finished = runs.where(F.col("o_orderstatus") == "F").select("o_orderkey", "run_id", F.lit("completed").alias("status"), F.lit(1).alias("seq"))
    return M.upsert(started, finished, ["o_orderkey"], ["seq"]).drop("seq")


@query("k03_guarded_overwrite", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def k03(spark, sf):
    """Replace a written table; a shrinking version is refused."""
    path = scratch_path(spark, "gold")
    c = table(spark, sf, "customer")
    M.guarded_overwrite(spark, c.where(F.col("c_acctbal") > 0), path)
    M.guarded_overwrite(spark, c, path)
    try:
        M.guarded_overwrite(spark, c.where(F.col("c_acctbal") > 9000), path)
        raise AssertionError("a shrinking table was written")
    except ValueError:
        pass
    return read_current(spark, path).groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("k12_replace_table", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def k12(spark, sf):
    path = scratch_path(spark, "orders")
    replace_table(table(spark, sf, "orders"), path)
    return read_current(spark, path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("i03_export_query", "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def i03(spark, sf):
    """Write the result of a SQL statement and read it back."""
    table(spark, sf, "orders").createOrReplaceTempView("export_orders")
    sql = "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total FROM export_orders GROUP BY o_orderpriority"
    return export_query(spark, sql, scratch_path(spark, "export"))


@query(
    "j19_backlog_merge",
    """WITH f AS (SELECT o_custkey AS k, min(o_orderdate) AS a, max(o_orderdate) AS b, arg_max(o_orderpriority, (o_orderdate, o_orderpriority)) AS p FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
    g AS (SELECT o_custkey AS k, min(o_orderdate) AS a, max(o_orderdate) AS b, min(o_orderpriority) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT coalesce(f.k, g.k) AS k, epoch_us(least(f.a, g.a)) AS first_us, epoch_us(greatest(f.b, g.b)) AS last_us, coalesce(f.p, g.p) AS p FROM f FULL JOIN g ON f.k = g.k""",
)
def j19(spark, sf):
    """Discoveries merged into a backlog: first seen kept, last seen advanced."""
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    backlog = o.where(F.col("o_orderstatus") == "F").groupBy("k").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"), F.min("o_orderpriority").alias("p"))
    found = o.where(F.col("o_orderstatus") == "O").select("k", F.col("o_orderdate").alias("a"), F.col("o_orderdate").alias("b"), F.col("o_orderpriority").alias("p"))
    out = M.backlog_merge(backlog, found, "k", "a", "b", ["p"])
    return out.select("k", F.unix_micros("a").alias("first_us"), F.unix_micros("b").alias("last_us"), "p")


@query(
    "j20_carry_forward",
    """WITH cur AS (SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN o_custkey END AS url, o_orderpriority AS id, 'new' AS note FROM orders),
    u AS (SELECT c_custkey, min(c_mktsegment) AS n FROM customer WHERE c_acctbal > 3000 GROUP BY 1), i AS (SELECT o_orderpriority, min(o_orderstatus) AS n FROM orders WHERE o_orderpriority < '4' GROUP BY 1)
    SELECT o_orderkey, coalesce(u.n, i.n, note) AS note FROM cur LEFT JOIN u ON u.c_custkey = cur.url LEFT JOIN i ON i.o_orderpriority = cur.id""",
)
def j20(spark, sf):
    """Notes from a prior snapshot matched by url, else by id."""
    o = table(spark, sf, "orders")
    cur = o.select("o_orderkey", F.when(F.col("o_totalprice") > 250000, F.col("o_custkey")).alias("url"), F.col("o_orderpriority").alias("id"), F.lit("new").alias("note"))
    by_url = table(spark, sf, "customer").where(F.col("c_acctbal") > 3000).select(F.col("c_custkey").alias("url"), F.lit(None).cast("string").alias("id"), F.col("c_mktsegment").alias("note"))
    by_id = o.where(F.col("o_orderpriority") < "4").select(F.lit(None).cast("bigint").alias("url"), F.col("o_orderpriority").alias("id"), F.col("o_orderstatus").alias("note"))
    return M.carry_forward(cur, by_url.unionByName(by_id), ["url", "id"], ["note"]).select("o_orderkey", "note")


@query(
    "j23_curated_sync",
    """WITH c AS (SELECT o_custkey AS k, max(o_orderdate) AS d, count(*) AS a FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), e AS (SELECT o_custkey AS k, min(o_orderdate) AS d, count(*) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT c_custkey AS k, epoch_us(coalesce(c.d, e.d, TIMESTAMP '1990-01-01')) AS discovered_us, coalesce(greatest(c.a, e.a), 0) AS attempts FROM customer LEFT JOIN c ON c.k = c_custkey LEFT JOIN e ON e.k = c_custkey""",
)
def j23(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    side = lambda status, fn: o.where(F.col("o_orderstatus") == status).groupBy("k").agg(fn("o_orderdate").alias("discovered_at"), F.count("*").alias("attempts"))
    curated = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit("1990-01-01").cast("timestamp").alias("captured_at"))
    out = M.curated_sync(curated, side("O", F.max), side("F", F.min), "k")
    return out.select("k", F.unix_micros("discovered_at").alias("discovered_us"), "attempts")


@query(
    "j24_cached_pages",
    "SELECT page_id, u.kind, length(html) AS n_chars FROM pages LEFT JOIN (SELECT url, min(CASE WHEN contains(url, '?') THEN 'query' ELSE 'plain' END) AS kind FROM pages WHERE length(html) > 500 GROUP BY 1) u USING (url)",
)
def j24(spark, sf):
    """Candidates joined with their stored payloads by url."""
    p = table(spark, sf, "pages")
    seen = p.where(F.length("html") > 500).groupBy("url").agg(F.min(F.when(F.contains("url", F.lit("?")), "query").otherwise("plain")).alias("kind"))
    return p.join(seen, "url", "left").select("page_id", "kind", F.length("html").cast("bigint").alias("n_chars"))


@query("u01_union_by_name", "SELECT c_custkey AS k, c_acctbal AS bal, c_mktsegment AS seg, NULL AS nk FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_nationkey FROM supplier")
def u01(spark, sf):
    """Union with missing columns and widened types."""
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("k"), F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("nk"))
    return M.union_by_name(a, b)


@query("u02_concat_parts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def u02(spark, sf):
    """Parts read apart and concatenated."""
    o = table(spark, sf, "orders")
    parts = [o.where(F.col("o_orderstatus") == s) for s in "FOP"]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("u03_key_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def u03(spark, sf):
    big = table(spark, sf, "orders").where(F.col("o_totalprice") > 300000).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").subtract(big)


@query("u04_distinct", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def u04(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@query("u05_key_intersection", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def u05(spark, sf):
    s = table(spark, sf, "supplier").where(F.col("s_acctbal") > 5000).select(F.col("s_nationkey").alias("k"))
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(s)
