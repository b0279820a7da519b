"""Books, signals, quotes, settlement and back-test pricing over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.operators import reports as R
from skyledger.operators import trade as X
from skyledger.plans import roles
from skyledger.plans.registry import query
from skyledger.plans.roles import with_roles
from skyledger.sources.tables import table

BOOKS = """books AS (SELECT l_orderkey AS market_id, l_linenumber AS ordinal, l_partkey, l_suppkey, l_extendedprice, l_returnflag || l_linenumber AS outcome_label,
    l_extendedprice / 110000 AS fair, round(0.05 + l_discount * 9, 2) AS ask, round(greatest(0.04 + l_discount * 9 - l_tax, 0.01), 2) AS bid,
    l_quantity AS qty, CASE WHEN l_quantity < 4 THEN 'missing' ELSE 'clob' END AS source FROM lineitem),
  cand AS (SELECT *, greatest(ask - bid, 0) AS spread, qty / 50 + qty / 25 + qty / 40 AS liquidity, ask * 30 / 10000 AS fee, fair - ask AS raw_gap, fair - ask - ask * 30 / 10000 AS after_fee,
    CASE WHEN qty / 50 >= 1 THEN 0.0 WHEN qty / 50 + qty / 25 >= 1 - 1e-9 THEN qty / 50 * ask + (1 - qty / 50) * (ask + 0.02) - ask END AS slip FROM books WHERE source = 'clob'),
  ranked AS (SELECT *, after_fee - slip AS cost_edge FROM cand)"""


def books(spark, sf):
    """One order book per line item: two asks and one bid around the line's price."""
    q = F.col("l_quantity")
    ask = F.round(0.05 + F.col("l_discount") * 9, 2)
    bid = F.round(F.greatest(0.04 + F.col("l_discount") * 9 - F.col("l_tax"), F.lit(0.01)), 2)

    def level(price, size):
        return F.struct(price.alias("price"), size.alias("size"))

    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("market_id"),
        F.col("l_linenumber").alias("ordinal"),
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("outcome_label"),
        (F.col("l_extendedprice") / 110000).alias("fair_probability"),
        X.normalize_levels(F.array(level(ask + 0.02, q / 25), level(ask, q / 50)), "ask").alias("asks"),
        X.normalize_levels(F.array(level(bid, q / 40)), "bid").alias("bids"),
        F.when(q < 4, "missing").otherwise("clob").alias("source"),
        q.alias("qty"),
    )


ORDINAL = ["ordinal", "l_extendedprice", "l_partkey", "l_suppkey"]


@query(
    "w11_depth_walk",
    f"WITH {BOOKS} SELECT ordinal, count(*) AS books, count(slip) AS fillable, round(sum(slip), 6) AS slippage FROM cand GROUP BY ordinal",
)
def w11(spark, sf):
    """Slippage of a unit order against every book."""
    b = books(spark, sf).where(F.col("source") == "clob")
    s = X.book_slippage("buy", F.col("asks"), F.lit(1.0))
    return b.withColumn("slip", s).groupBy("ordinal").agg(
        F.count("*").alias("books"), F.count("slip").alias("fillable"), F.round(F.sum("slip"), 6).alias("slippage")
    )


@query(
    "s36_book_metrics",
    f"WITH {BOOKS} SELECT market_id, outcome_label, l_partkey, l_suppkey, round(ask, 4) AS best_ask, bid AS best_bid, round(qty / 50 + qty / 25 + qty / 40, 6) AS liquidity FROM books",
)
def s36(spark, sf):
    return books(spark, sf).select(
        "market_id",
        "outcome_label",
        "l_partkey",
        "l_suppkey",
        F.round(X.best_ask(F.col("asks")), 4).alias("best_ask"),
        X.best_bid(F.col("bids")).alias("best_bid"),
        F.round(X.visible_liquidity(F.col("bids"), F.col("asks")), 6).alias("liquidity"),
    )


REASONS = f"""WITH {BOOKS}, m AS (SELECT market_id, arg_max({{'a': ask, 'b': bid, 'l': liquidity, 'e': cost_edge, 'o': outcome_label, 's': spread, 'g': raw_gap}}, (cost_edge, -ordinal, -l_extendedprice, -l_partkey, -l_suppkey)) FILTER (cost_edge IS NOT NULL) AS c,
    arg_max({{'a': ask, 'b': bid, 'l': liquidity, 'e': cost_edge, 'o': outcome_label, 's': spread, 'g': raw_gap}}, (after_fee, -ordinal, -l_extendedprice, -l_partkey, -l_suppkey)) AS f,
    bool_or(after_fee > 0 AND slip IS NULL) AS deep, bool_or(after_fee > 0) AS fee_ok, bool_or(raw_gap > 0) AS raw_ok FROM ranked GROUP BY market_id),
  r AS (SELECT b.market_id, b.n AS book_count, CASE WHEN m.f IS NULL THEN 'missing_book' WHEN c.e > 0 THEN
      CASE WHEN NOT ((c.a - c.b) / greatest((c.a + c.b) / 2, 1e-6) * 10000 <= 2000) THEN 'after_cost_positive_but_spread_too_wide' WHEN c.l < 2 THEN 'after_cost_positive_but_liquidity_too_low'
        WHEN c.e < 0.1 THEN 'after_cost_positive_but_below_threshold' ELSE 'tradable' END
      WHEN deep THEN 'insufficient_depth' WHEN fee_ok THEN 'slippage_killed_edge' WHEN raw_ok THEN 'fee_killed_edge' ELSE 'raw_gap_non_positive' END AS reason,
    coalesce(m.c, m.f) AS p FROM (SELECT market_id, count(*) AS n FROM books GROUP BY 1) b LEFT JOIN m USING (market_id))"""


@query(
    "s25_signal_reasons",
    f"{REASONS} SELECT market_id, book_count, reason, p.o AS outcome_label, round(p.a, 4) AS best_ask, round(p.s, 6) AS spread, round(p.e, 6) AS after_cost_edge FROM r",
)
def s25(spark, sf):
    """Reason ladder per market over its candidate outcomes."""
    out = X.signal_reasons(books(spark, sf), ["market_id"], ORDINAL, 0.1, 2000, 2.0)
    return out.select(
        "market_id",
        "book_count",
        "reason",
        "outcome_label",
        F.round("best_ask", 4).alias("best_ask"),
        F.round("spread", 6).alias("spread"),
        F.round("after_cost_edge", 6).alias("after_cost_edge"),
    )


@query(
    "s25_without_books",
    f"{REASONS.replace('FROM lineitem),', 'FROM lineitem WHERE l_linenumber > 2),', 1)} SELECT o_orderkey AS market_id, coalesce(book_count, 0) AS book_count, coalesce(reason, 'missing_token_mapping') AS reason FROM orders LEFT JOIN r ON market_id = o_orderkey",
)
def s25w(spark, sf):
    """Markets whose tokens lead to no book keep a row."""
    markets = table(spark, sf, "orders").select(F.col("o_orderkey").alias("market_id"))
    out = X.signal_reasons(books(spark, sf).where("ordinal > 2"), ["market_id"], ORDINAL, 0.1, 2000, 2.0, markets=markets)
    return out.select("market_id", "book_count", "reason")


@query("w14_reason_counts", f"{REASONS} SELECT reason, count(*) AS n FROM r GROUP BY 1")
def w14(spark, sf):
    """Best candidate per market by after-cost, then after-fee edge; counts of the verdicts."""
    return X.signal_reasons(books(spark, sf), ["market_id"], ORDINAL, 0.1, 2000, 2.0).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "s20_edges_and_fees",
    f"WITH {BOOKS} SELECT outcome_label, count(*) AS n, round(sum(fee), 6) AS fees, round(avg(after_fee), 6) AS avg_edge_after_fee, round(avg(raw_gap), 6) AS avg_raw_gap FROM cand GROUP BY 1",
)
def s20(spark, sf):
    c = X.rank_candidates(books(spark, sf))
    return c.groupBy("outcome_label").agg(
        F.count("*").alias("n"),
        F.round(F.sum("fee_estimate"), 6).alias("fees"),
        F.round(F.avg("edge_after_fee"), 6).alias("avg_edge_after_fee"),
        F.round(F.avg("raw_gap"), 6).alias("avg_raw_gap"),
    )


@query(
    "s21_guardrails",
    f"WITH {BOOKS} SELECT market_id, count(*) FILTER ((ask - bid) / greatest((ask + bid) / 2, 1e-6) * 10000 <= 900) AS spread_ok, count(*) FILTER (qty + 10 <= 45) AS exposure_ok FROM books GROUP BY 1",
)
def s21(spark, sf):
    ok = X.spread_ok(X.best_bid(F.col("bids")), X.best_ask(F.col("asks")), 900)
    return books(spark, sf).groupBy("market_id").agg(
        R.count_if(ok).alias("spread_ok"), R.count_if(X.exposure_ok(F.col("qty"), F.lit(10), 45)).alias("exposure_ok")
    )


@query(
    "s22_quote_proxy",
    with_roles(
        "trades",
        """SELECT outcome_label, round(price, 2) AS price, round(greatest(0.0005, least(greatest(price, 0.0005), 0.9995) - 0.1), 6) AS bid, round(least(0.9995, least(greatest(price, 0.0005), 0.9995) + 0.1), 6) AS ask, count(*) AS n
    FROM trades GROUP BY ALL""",
    ),
)
def s22(spark, sf):
    t = roles.trades(spark, sf).withColumn("q", X.quote_proxy(F.col("price"), F.lit(0.1)))
    return t.groupBy(
        "outcome_label", F.round("price", 2).alias("price"), F.round("q.bid", 6).alias("bid"), F.round("q.ask", 6).alias("ask")
    ).agg(F.count("*").alias("n"))


@query(
    "s23_capped_kelly",
    with_roles(
        "trades",
        """SELECT decision_horizon, round(sum(CASE WHEN price > 0 AND price < 1 AND edge > 0 THEN 1000 * least(greatest(((1 / price - 1) * (price + edge) - (1 - price - edge)) / (1 / price - 1), 0), 0.05) ELSE 0 END), 4) AS stake,
    count(*) FILTER (edge > 0) AS bets FROM trades GROUP BY 1""",
    ),
)
def s23(spark, sf):
    stake = X.capped_kelly(F.col("edge"), F.col("price") + F.col("edge"), F.lit(1000.0), F.col("price"))
    return roles.trades(spark, sf).groupBy("decision_horizon").agg(
        F.round(F.sum(stake), 4).alias("stake"), R.count_if(F.col("edge") > 0).alias("bets")
    )


@query(
    "s24_settlement",
    with_roles(
        "trades",
        """SELECT outcome_label, round(sum((CAST(outcome_label = winning_outcome AS INT) - price) * size - 0.03), 2) AS buy_pnl,
    round(sum((price - CAST(outcome_label = winning_outcome AS INT)) * size), 2) AS sell_pnl FROM trades GROUP BY 1""",
    ),
)
def s24(spark, sf):
    won = F.col("outcome_label") == F.col("winning_outcome")
    buy = X.settle(F.col("price"), F.col("size"), won, F.lit("buy"), 0.03)
    sell = X.settle(F.col("price"), F.col("size"), won, F.lit("sell"))
    return roles.trades(spark, sf).groupBy("outcome_label").agg(
        F.round(F.sum(buy), 2).alias("buy_pnl"), F.round(F.sum(sell), 2).alias("sell_pnl")
    )


@query(
    "s24_paper_outcomes",
    with_roles(
        "trades",
        """WITH o AS (SELECT *, CASE WHEN price >= 0.95 THEN 'won' WHEN price <= 0.05 THEN 'lost' END AS outcome, CASE WHEN edge > 0 THEN 'yes' ELSE 'no' END AS dir FROM trades)
    SELECT outcome, dir, count(*) AS n, round(sum(CAST(CASE WHEN outcome IS NULL THEN NULL WHEN dir = 'yes' THEN CASE WHEN outcome = 'won' THEN 0.6 ELSE -0.4 END ELSE CASE WHEN outcome = 'lost' THEN 0.4 ELSE -0.6 END END AS DOUBLE)), 4) AS pnl FROM o GROUP BY ALL""",
    ),
)
def s24p(spark, sf):
    t = roles.trades(spark, sf).withColumn("outcome", X.paper_outcome(F.col("price"), 0.95, 0.05))
    t = t.withColumn("dir", F.when(F.col("edge") > 0, "yes").otherwise("no"))
    return t.groupBy("outcome", "dir").agg(
        F.count("*").alias("n"), F.round(F.sum(X.paper_pnl(F.col("dir"), F.lit(0.4), F.col("outcome"))), 4).alias("pnl")
    )


@query(
    "f05_price_bands",
    with_roles(
        "trades",
        """SELECT CASE WHEN edge > 0 THEN 'yes' ELSE 'no' END AS direction, round(price, 2) AS price, count(*) AS n FROM trades
    WHERE (edge > 0 AND price BETWEEN 0.30 AND 0.40) OR (edge <= 0 AND price BETWEEN 0.50 AND 0.70) GROUP BY ALL""",
    ),
)
def f05(spark, sf):
    t = roles.trades(spark, sf).withColumn("direction", F.when(F.col("edge") > 0, "yes").otherwise("no"))
    kept = X.band_filter(t, "price", "direction", (0.30, 0.40), (0.50, 0.70))
    return kept.groupBy("direction", F.round("price", 2).alias("price")).agg(F.count("*").alias("n"))


@query(
    "f10_edge_scan",
    f"""WITH {BOOKS}, s AS (SELECT *, fair - ask - ask * 30 / 10000 AS yes_edge, (1 - fair) - (1 - ask) - (1 - ask) * 30 / 10000 AS no_edge FROM books WHERE fair BETWEEN 0.02 AND 0.98 AND ask > 0 AND ask < 1),
    t AS (SELECT *, greatest(yes_edge, no_edge) AS best_edge, CASE WHEN yes_edge >= no_edge THEN 'yes' ELSE 'no' END AS direction FROM s)
    SELECT market_id, outcome_label, l_partkey, l_suppkey, direction, round(best_edge, 6) AS best_edge FROM t WHERE abs(best_edge) >= 0.05""",
)
def f10(spark, sf):
    b = books(spark, sf).withColumn("market_price", X.best_ask(F.col("asks"))).withColumnRenamed("fair_probability", "model_prob")
    out = X.edge_scan(b)
    return out.select("market_id", "outcome_label", "l_partkey", "l_suppkey", "direction", F.round("best_edge", 6).alias("best_edge"))


@query(
    "s37_quotes",
    f"""WITH {BOOKS}, q AS (SELECT market_id, ordinal, l_extendedprice, l_partkey, l_suppkey, outcome_label, fair, qty * 2 AS net FROM books WHERE source = 'clob'),
    p AS (SELECT *, greatest(least(fair - 0.02 - net * 0.5 / 90, 0.99), 0.01) AS b, greatest(least(fair + 0.02 - net * 0.5 / 90, 0.99), 0.01) AS a, 10 * greatest(1 - net / 90, 0) AS size FROM q),
    e AS (SELECT * FROM p WHERE size > 0 QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY ordinal, l_extendedprice, l_partkey, l_suppkey) <= 2)
    SELECT market_id, outcome_label, l_partkey, l_suppkey, CASE WHEN b >= a THEN round(greatest((a + b) / 2 - 0.005, 0.01), 4) ELSE round(b, 4) END AS bid_price,
    CASE WHEN b >= a THEN round(least((a + b) / 2 + 0.005, 0.99), 4) ELSE round(a, 4) END AS ask_price, round(size, 2) AS size FROM e""",
)
def s37(spark, sf):
    """Inventory-skewed quotes within an order budget of three per market."""
    b = books(spark, sf).where(F.col("source") == "clob").select(
        "market_id", "ordinal", "l_extendedprice", "l_partkey", "l_suppkey", "outcome_label", "fair_probability",
        (F.col("qty") * 2).alias("net_position"), F.col("outcome_label").alias("token_id"),
    )
    out = X.two_sided_quotes(b, ["market_id"], ORDINAL, max_position=90.0, max_orders=3)
    return out.select("market_id", "outcome_label", "l_partkey", "l_suppkey", "bid_price", "ask_price", "size")


@query(
    "s38_forecast_exits",
    """WITH p AS (SELECT o_custkey, o_orderpriority, avg(o_totalprice) / 500000 AS prob FROM orders GROUP BY ALL), h AS (SELECT c_custkey, x.o_orderpriority FROM customer, (SELECT DISTINCT o_orderpriority FROM orders) x WHERE c_acctbal > 0)
    SELECT h.c_custkey, h.o_orderpriority FROM h LEFT JOIN p ON p.o_custkey = h.c_custkey AND p.o_orderpriority = h.o_orderpriority WHERE coalesce(prob, 0) < 0.3""",
)
def s38(spark, sf):
    """Held outcomes that have become unlikely; an absent probability counts as 0."""
    o = table(spark, sf, "orders")
    probs = o.groupBy(F.col("o_custkey").alias("c_custkey"), "o_orderpriority").agg((F.avg("o_totalprice") / 500000).alias("prob"))
    outcomes = F.array(*[F.lit(p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    held = table(spark, sf, "customer").where(F.col("c_acctbal") > 0).select("c_custkey", F.explode(outcomes).alias("o_orderpriority"))
    return X.forecast_exits(held, probs, ["c_custkey", "o_orderpriority"], 0.3).select("c_custkey", "o_orderpriority")


@query(
    "j21_mispricings",
    f"WITH {BOOKS} SELECT market_id, outcome_label, l_partkey, l_suppkey, round(fair - ask, 6) AS mispricing FROM cand WHERE abs(fair - ask) > 0.02",
)
def j21(spark, sf):
    out = X.mispricings(X.rank_candidates(books(spark, sf)))
    return out.select("market_id", "outcome_label", "l_partkey", "l_suppkey", F.round("mispricing", 6).alias("mispricing"))


@query(
    "j21_top_outcomes",
    f"""WITH {BOOKS}, t AS (SELECT market_id, outcome_label, row_number() OVER (PARTITION BY market_id ORDER BY fair DESC, ordinal, l_extendedprice, l_partkey, l_suppkey) AS rn FROM books)
    SELECT market_id, string_agg(outcome_label, ',' ORDER BY rn) AS labels FROM t WHERE rn <= 3 GROUP BY 1""",
)
def j21t(spark, sf):
    out = X.top_outcomes(books(spark, sf), ["market_id"], ORDINAL)
    return out.select("market_id", F.array_join(F.transform("top_outcomes", lambda t: t["label"]), ",").alias("labels"))


def priced(spark, sf):
    """Panel rows with a fair probability from the event volume of the token."""
    p = roles.panel(spark, sf).withColumn("market_price", F.col("market_price") / 500)
    return p.withColumn("ordinal", F.col("token_id")).withColumn(
        "fair_probability", F.when(F.col("token_id") < "f", 0.05).otherwise(0.03)
    )


PRICED = """pr AS (SELECT decision_id, city, decision_horizon, outcome, best.m AS mp, best.a AS age, best.t AS token_id FROM (SELECT decision_id, any_value(city) AS city, any_value(decision_horizon) AS decision_horizon,
    CASE WHEN NOT bool_or(coverage_status = 'ok') THEN CASE WHEN bool_or(coverage_status = 'stale') THEN 'stale_price' ELSE 'missing_price' END
      WHEN max(e) FILTER (e >= 0.01) IS NOT NULL THEN 'traded' WHEN bool_or(elig) AND NOT coalesce(bool_or(e > 0), false) THEN 'non_positive_edge' ELSE 'execution_filter' END AS outcome,
    arg_max({'m': market_price / 500, 'a': price_age_seconds, 't': token_id}, (e, CASE token_id WHEN 'click' THEN 5 WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END)) FILTER (e >= 0.01) AS best
    FROM (SELECT *, CASE WHEN elig THEN CASE WHEN token_id < 'f' THEN 0.05 ELSE 0.03 END - PX - PX * 30 / 10000 END AS e FROM
      (SELECT *, coalesce(coverage_status = 'ok' AND PX >= 0.012 AND PX <= 0.9, false) AS elig FROM panel)) GROUP BY decision_id))"""


def trade_query(spark, sf, half_spread=None):
    p = priced(spark, sf)
    price = F.col("market_price") if half_spread is None else X.quote_proxy(F.col("market_price"), F.lit(half_spread))["ask"]
    # Tokens are ordered by name; the first one wins a tie.
    names = sorted(roles.EVENT_TYPES)
    ordinal = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("token_id"))
    p = p.withColumn("executable_price", price).withColumn("ordinal", ordinal)
    return X.best_trades(
        p, ["decision_id", "city", "decision_horizon"], ["ordinal"], 0.012, 0.9, 0.01, carry=["price_age_seconds", "token_id"]
    )


@query(
    "w21_best_trades",
    with_roles(
        "panel",
        f"WITH {PRICED.replace('PX', '(market_price / 500)')} SELECT decision_id, outcome, round(mp, 6) AS market_price, round(age, 6) AS price_age_seconds, token_id FROM pr",
    ),
)
def w21(spark, sf):
    """Best positive-edge outcome of every decision, or why there is none."""
    t = trade_query(spark, sf)
    return t.select(
        "decision_id", "outcome", F.round("market_price", 6).alias("market_price"),
        F.round("price_age_seconds", 6).alias("price_age_seconds"), "token_id",
    )


@query(
    "a49_skip_accounting",
    with_roles("panel", f"WITH {PRICED.replace('PX', '(market_price / 500)')} SELECT decision_horizon, outcome, count(*) AS n FROM pr GROUP BY ALL"),
)
def a49(spark, sf):
    return trade_query(spark, sf).groupBy("decision_horizon", "outcome").agg(F.count("*").alias("n"))


@query(
    "j25_price_sources",
    with_roles(
        "panel",
        f"""WITH {PRICED.replace('PX', '(market_price / 500)')}, {PRICED.replace('PX', 'least(0.9995, greatest(market_price / 500, 0.0005) + 0.005)').replace('pr AS', 'qp AS', 1)}
    SELECT pr.outcome AS real_outcome, qp.outcome AS proxy_outcome, count(*) AS n FROM pr JOIN qp USING (decision_id) GROUP BY ALL""",
    ),
)
def j25(spark, sf):
    """Real prices and the quote proxy side by side."""
    a = trade_query(spark, sf).select("decision_id", F.col("outcome").alias("real_outcome"))
    b = trade_query(spark, sf, 0.005).select("decision_id", F.col("outcome").alias("proxy_outcome"))
    return a.join(b, "decision_id").groupBy("real_outcome", "proxy_outcome").agg(F.count("*").alias("n"))


SOURCES = """a AS (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) / 500000 AS price FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    b AS (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) / 500000 AS price FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)"""


@query(
    "j13_price_source",
    f"""WITH {SOURCES} SELECT c_custkey, round(coalesce(a.price, b.price), 8) AS latest_price, CASE WHEN a.price IS NOT NULL THEN 'silver' WHEN b.price IS NOT NULL THEN 'gamma_log' END AS price_source
    FROM customer LEFT JOIN a ON a.o_custkey = c_custkey LEFT JOIN b ON b.o_custkey = c_custkey""",
)
def j13(spark, sf):
    """First known price of two sources with its origin."""
    o = table(spark, sf, "orders")

    def latest(status):
        return o.where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("c_custkey")).agg(
            (F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")) / 500000).alias("price")
        )

    out = X.first_known_price(table(spark, sf, "customer"), latest("F"), latest("O"), ["c_custkey"])
    return out.select("c_custkey", F.round("latest_price", 8).alias("latest_price"), "price_source")


@query(
    "j14_watch_alerts",
    f"""WITH {BOOKS}, low AS (SELECT outcome_label, l_suppkey, min(ask) AS best_ask FROM books GROUP BY ALL),
    rules AS (SELECT s_suppkey, 'A' || x.i AS outcome_label, 0.05 + (s_nationkey / 100.0) AS threshold FROM supplier, (VALUES (1), (2), (3)) x(i))
    SELECT s_suppkey, rules.outcome_label, round(threshold - best_ask, 6) AS gap FROM rules JOIN low ON low.l_suppkey = s_suppkey AND low.outcome_label = rules.outcome_label WHERE best_ask <= threshold""",
)
def j14(spark, sf):
    b = books(spark, sf).select(F.col("l_suppkey").alias("s_suppkey"), "outcome_label", X.best_ask(F.col("asks")).alias("best_ask"))
    rules = table(spark, sf, "supplier").select(
        "s_suppkey",
        F.explode(F.array(F.lit("A1"), F.lit("A2"), F.lit("A3"))).alias("outcome_label"),
        (0.05 + F.col("s_nationkey") / 100.0).alias("threshold"),
    )
    return X.watch_alerts(b, rules, ["s_suppkey", "outcome_label"]).select("s_suppkey", "outcome_label", F.round("gap", 6).alias("gap"))


# --- observation queue, priorities ---------------------------------------------

OBS_SQL = """obs AS (SELECT *, CASE WHEN k < 50 THEN 'exact_public' ELSE 'research_public' END AS track, k > 10 AS eligible, CASE WHEN k < 95 THEN k * 2.0 END AS age,
    CASE WHEN spread > 0.05 THEN spread END AS mass FROM opportunities)"""
FLAG_SQL = """list_filter([CASE WHEN track <> 'exact_public' THEN 'research_public' END, CASE WHEN NOT eligible THEN 'settlement_ineligible' END,
    CASE WHEN age IS NULL THEN 'missing_observation' WHEN age > 60 THEN 'stale_observation' END,
    CASE reason WHEN 'after_cost_positive_but_spread_too_wide' THEN 'wide_spread' WHEN 'missing_book' THEN 'missing_book' END,
    CASE WHEN coalesce(mass, 0) <= 0 THEN 'no_observation_dislocation' END], lambda x: x IS NOT NULL)"""


def observed(spark, sf):
    o = roles.opportunities(spark, sf)
    k = F.col("k")
    flags = X.risk_flags(
        F.when(k < 50, "exact_public").otherwise("research_public"), k > 10, F.col("reason"),
        F.when(k < 95, k * 2.0), 60.0, F.when(F.col("spread") > 0.05, F.col("spread")),
    )
    return o.withColumn("flags", flags).withColumn("queue_state", X.queue_state(F.col("reason"), F.col("flags")))


@query(
    "s27_risk_queue",
    with_roles(
        "opportunities",
        f"""WITH {OBS_SQL}, f AS (SELECT *, {FLAG_SQL} AS flags FROM obs) SELECT event_id, array_to_string(flags, ',') AS flags,
    CASE WHEN list_has_any(flags, ['missing_observation', 'missing_book']) THEN 'blocked' WHEN reason = 'tradable' AND NOT list_has_any(flags, ['research_public', 'stale_observation']) THEN 'tradable'
      WHEN reason IN ('tradable', 'after_cost_positive_but_spread_too_wide') THEN 'manual_review' ELSE 'blocked' END AS queue_state FROM f""",
    ),
)
def s27(spark, sf):
    return observed(spark, sf).select("event_id", F.array_join("flags", ",").alias("flags"), "queue_state")


@query(
    "s28_approval_tokens",
    with_roles("opportunities", "SELECT event_id, substr(sha256(concat_ws('|', market_id, reason, strftime(observed_at, '%Y-%m-%dT%H:%M:%S'), coalesce(city, ''))), 1, 16) AS token FROM opportunities"),
)
def s28(spark, sf):
    at = F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss")
    return roles.opportunities(spark, sf).select(
        "event_id", X.approval_token(F.col("market_id"), F.col("reason"), at, F.col("city")).alias("token")
    )


@query(
    "s29_priority_scores",
    with_roles(
        "opportunities",
        """WITH p AS (SELECT *, CASE WHEN k < 90 THEN k END AS age, k % 4 - 1 AS dist, CASE WHEN spread < 0.5 THEN spread * 40000 END AS vol FROM opportunities)
    SELECT event_id, CASE WHEN age IS NULL THEN 'unknown_open_time' WHEN age <= 24 THEN CASE reason WHEN 'after_cost_positive_but_spread_too_wide' THEN 'fresh_listing_spread_blocked' ELSE 'fresh_listing' END WHEN city < 'NATION_15' THEN 'mature_core' ELSE 'mature_expansion' END AS bucket,
    round(CASE WHEN age IS NULL THEN -8 WHEN age <= 6 THEN 40 WHEN age <= 24 THEN 32 WHEN age <= 48 THEN 20 ELSE 8 END + CASE WHEN dist >= 2 THEN 20 WHEN dist = 1 THEN 10 WHEN dist = 0 THEN 4 ELSE 0 END
      + CASE WHEN vol IS NULL THEN 2 WHEN vol <= 500 THEN 12 WHEN vol <= 2000 THEN 9 WHEN vol <= 10000 THEN 4 ELSE -2 END
      + CASE reason WHEN 'tradable' THEN 18 WHEN 'after_cost_positive_but_spread_too_wide' THEN 14 WHEN 'raw_gap_non_positive' THEN 0 ELSE 6 END
      + coalesce(greatest(least(raw_gap * 200, 10), -10), 0) + coalesce(greatest(least(after_cost_edge * 400, 20), -20), 0), 6) AS score,
    coalesce(after_cost_edge > 0, false) OR coalesce(reason = 'after_cost_positive_but_spread_too_wide' AND age <= 24, false) AS alert FROM p""",
    ),
)
def s29(spark, sf):
    """Listing priority: bucket, score and alert."""
    o = roles.opportunities(spark, sf)
    age = F.when(F.col("k") < 90, F.col("k"))
    volume = F.when(F.col("spread") < 0.5, F.col("spread") * 40000)
    reason = F.col("reason")
    return o.select(
        "event_id",
        X.priority_bucket(age, reason, F.col("city") < "NATION_15").alias("bucket"),
        X.priority_score(age, F.col("k") % 4 - 1, volume, reason, F.col("raw_gap"), F.col("after_cost_edge")).alias("score"),
        X.candidate_alert(reason, age, F.col("after_cost_edge")).alias("alert"),
    )
