"""Policy filters, books, edges, sizing, reason ladders and settlement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.operators.quantiles import null_safe_join


def policy_condition(policy: Sequence[tuple[str, Sequence[str]]], city: Column, horizon: Column, strict: bool) -> Column:
    """Whether a city's listed horizons allow the row. The policy is a fixed
    configuration, so it becomes a literal map and nothing is joined."""
    entries = [x for name, horizons in policy for x in (F.lit(name), F.array(*[F.lit(h) for h in horizons]))]
    allowed = F.try_element_at(F.create_map(*entries), city)
    unlisted = F.lit(not strict)
    return F.coalesce(F.array_contains(allowed, horizon), unlisted)


def policy_filter(
    df: DataFrame,
    policy: Sequence[tuple[str, Sequence[str]]],
    city: str = "city",
    horizon: str = "decision_horizon",
    strict: bool = False,
) -> DataFrame:
    """Keep rows a horizon policy allows; an unlisted city allows all, or with
    ``strict`` nothing."""
    return df.where(policy_condition(policy, F.coalesce(F.col(city), F.lit("")), F.col(horizon), strict))


LEVEL_TYPE = "array<struct<price:double,size:double>>"


def fee(notional: Column, taker_bps: float = 30.0) -> Column:
    return notional * taker_bps / 10_000.0


def edge(fair: Column, price: Column, fee_paid: Column | float = 0.0, slippage: Column | float = 0.0) -> Column:
    """Probability edge after costs."""
    return fair - price - fee_paid - slippage


def normalize_levels(levels: Column, side: str, depth: int = 5) -> Column:
    """Best levels first (bids falling, asks rising), at most ``depth``."""
    ordered = F.sort_array(levels, asc=(side == "ask"))
    return F.slice(ordered, 1, depth)


def best_bid(bids: Column) -> Column:
    return F.coalesce(F.get(bids, F.lit(0))["price"], F.lit(0.0))


def best_ask(asks: Column) -> Column:
    return F.coalesce(F.get(asks, F.lit(0))["price"], F.lit(1.0))


def visible_liquidity(bids: Column, asks: Column) -> Column:
    return F.aggregate(F.concat(bids, asks), F.lit(0.0), lambda acc, lv: acc + lv["size"])


def book_slippage(side: str, levels: Column, size: Column) -> Column:
    """Distance of the filled average price from the best level; null when the
    visible book cannot fill the size, 0 for an empty order."""
    start = F.struct(size.cast("double").alias("left"), F.lit(0.0).alias("paid"))

    def fill(acc: Column, lv: Column) -> Column:
        take = F.greatest(F.least(lv["size"], acc["left"]), F.lit(0.0))
        return F.struct((acc["left"] - take).alias("left"), (acc["paid"] + take * lv["price"]).alias("paid"))

    walked = F.aggregate(levels, start, fill)
    average = walked["paid"] / size
    top = F.get(levels, F.lit(0))["price"]
    away = average - top if side == "buy" else top - average
    return F.when(size <= 0, 0.0).when(
        (F.size(levels) > 0) & (walked["left"] <= 1e-9), F.greatest(away, F.lit(0.0))
    )


def spread_ok(bid: Column, ask: Column, max_bps: float) -> Column:
    """Spread relative to the middle, in basis points, within a limit."""
    middle = (bid + ask) / 2.0
    return (ask > 0) & (((ask - bid) / F.greatest(middle, F.lit(1e-6))) * 10_000.0 <= max_bps)


def exposure_ok(current: Column, proposed: Column, limit: float) -> Column:
    return current + proposed <= limit


def quote_proxy(price: Column, half_spread: Column, low: float = 0.0005, high: float = 0.9995) -> Column:
    """Struct of a conservative bid and ask around a last trade."""
    middle = F.least(F.greatest(price, F.lit(low)), F.lit(high))
    half = F.greatest(half_spread, F.lit(0.0))
    bid = F.greatest(middle - half, F.lit(low))
    return F.struct(bid.alias("bid"), F.greatest(F.least(middle + half, F.lit(high)), bid).alias("ask"))


def capped_kelly(edge_: Column, fair: Column, bankroll: Column, price: Column, cap: float = 0.05) -> Column:
    """Kelly stake for a binary token, capped; 0 without an edge or a real price."""
    odds = 1.0 / price - 1.0
    fraction = F.greatest((odds * fair - (1.0 - fair)) / odds, F.lit(0.0))
    usable = (price > 0) & (price < 1) & (edge_ > 0)
    return F.when(usable, bankroll * F.least(fraction, F.lit(cap))).otherwise(0.0)


def settle(price: Column, size: Column, won: Column, side: Column, fee_paid: Column | float = 0.0) -> Column:
    """Result of a settled position: bought tokens pay 1 when won, sold ones cost it."""
    payoff = F.when(won, 1.0).otherwise(0.0)
    gain = F.when(side == "sell", price - payoff).otherwise(payoff - price)
    return gain * size - fee_paid


def paper_outcome(latest: Column, won_at: float = 0.95, lost_at: float = 0.02) -> Column:
    """Settlement read off the latest price: won, lost or open (null)."""
    return F.when(latest >= won_at, "won").when(latest <= lost_at, "lost")


def paper_pnl(direction: Column, entry: Column, outcome: Column) -> Column:
    """Unit result of a yes or no bet entered at a yes price."""
    yes = F.when(outcome == "won", 1.0 - entry).otherwise(-entry)
    no = F.when(outcome == "lost", entry).otherwise(-(1.0 - entry))
    return F.when(outcome.isNotNull(), F.round(F.when(F.lower(direction) == "yes", yes).otherwise(no), 6))


def band_filter(df: DataFrame, price: str, direction: str, yes: tuple[float, float], no: tuple[float, float]) -> DataFrame:
    """Keep rows whose price lies in the band of their direction; a missing price passes."""
    p = F.col(price)
    inside = F.when(F.lower(direction) == "yes", p.between(*yes)).otherwise(
        (p >= no[0]) & ((F.lower(direction) != "no") | (p <= no[1]))
    )
    return df.where(p.isNull() | inside)


def with_costs(df: DataFrame, size: float = 1.0, taker_bps: float = 30.0) -> DataFrame:
    """Cost columns of every outcome: spread, liquidity, raw gap, edge after fee,
    slippage and edge after all costs (null when not fillable).

    Input: fair_probability, source, bids, asks. Without a live book and asks the
    edges are null.
    """
    live = (F.col("source") == "clob") & (F.size("asks") > 0)
    out = df.withColumn("live", live).withColumn("best_bid", best_bid(F.col("bids"))).withColumn("best_ask", best_ask(F.col("asks")))
    out = out.withColumns(
        {
            "spread": F.greatest(F.col("best_ask") - F.col("best_bid"), F.lit(0.0)),
            "visible_liquidity": visible_liquidity(F.col("bids"), F.col("asks")),
            "fee_estimate": fee(F.col("best_ask"), taker_bps),
            "slippage_estimate": book_slippage("buy", F.col("asks"), F.lit(size)),
            "raw_gap": F.when(F.col("live"), F.col("fair_probability") - F.col("best_ask")),
        }
    )
    return out.withColumn("edge_after_fee", F.col("raw_gap") - F.col("fee_estimate")).withColumn(
        "after_cost_edge", F.col("edge_after_fee") - F.col("slippage_estimate")
    )


def rank_candidates(df: DataFrame, size: float = 1.0, taker_bps: float = 30.0) -> DataFrame:
    """Cost columns of the outcomes that have a live book and asks."""
    return with_costs(df, size, taker_bps).where(F.col("live"))


def signal_reasons(
    books: DataFrame,
    keys: Sequence[str],
    ordinal: Sequence[str],
    edge_threshold: float,
    max_spread_bps: float,
    min_liquidity: float,
    size: float = 1.0,
    taker_bps: float = 30.0,
    markets: DataFrame | None = None,
) -> DataFrame:
    """Best outcome per market and the reason it is or is not tradable.

    One aggregate per market over all its books: argmaxes (first outcome wins a
    tie) and three flags, combined map-side. ``markets`` (its ``keys``) are all markets asked about: those
    without any book get a row with the reason ``missing_token_mapping``.
    """
    candidates = with_costs(books, size, taker_bps)
    earlier = [(-F.col(c)).alias(f"__o{i}") for i, c in enumerate(ordinal)]
    picked = F.struct("outcome_label", "best_bid", "best_ask", "spread", "visible_liquidity", "after_cost_edge", "edge_after_fee", "raw_gap")

    def best(by: str) -> Column:
        return F.max_by(picked, F.when(F.col(by).isNotNull(), F.struct(F.col(by), *earlier)))

    positive = F.col("edge_after_fee") > 0
    joined = candidates.groupBy(*keys).agg(
        F.count("*").alias("book_count"),
        best("after_cost_edge").alias("__cost"),
        best("edge_after_fee").alias("__fee"),
        F.bool_or(positive & F.col("slippage_estimate").isNull()).alias("__deep"),
        F.bool_or(positive).alias("__fee_ok"),
        F.bool_or(F.col("raw_gap") > 0).alias("__raw_ok"),
    )
    c = F.col("__cost")
    tradable = (
        F.when(~spread_ok(c["best_bid"], c["best_ask"], max_spread_bps), "after_cost_positive_but_spread_too_wide")
        .when(c["visible_liquidity"] < min_liquidity, "after_cost_positive_but_liquidity_too_low")
        .when(c["after_cost_edge"] < edge_threshold, "after_cost_positive_but_below_threshold")
        .otherwise("tradable")
    )
    reason = (
        F.when(F.col("__fee").isNull(), "missing_book")
        .when(c["after_cost_edge"] > 0, tradable)
        .when(F.col("__deep"), "insufficient_depth")
        .when(F.col("__fee_ok"), "slippage_killed_edge")
        .when(F.col("__raw_ok"), "fee_killed_edge")
        .otherwise("raw_gap_non_positive")
    )
    shown = F.coalesce(c, F.col("__fee"))
    out = joined.select(
        *keys,
        "book_count",
        reason.alias("reason"),
        shown["outcome_label"].alias("outcome_label"),
        shown["best_ask"].alias("best_ask"),
        shown["spread"].alias("spread"),
        shown["raw_gap"].alias("raw_gap"),
        shown["after_cost_edge"].alias("after_cost_edge"),
    )
    if markets is None:
        return out
    asked = null_safe_join(markets.select(*keys).distinct(), out, keys)
    return asked.withColumns({"book_count": F.coalesce("book_count", F.lit(0)), "reason": F.coalesce("reason", F.lit("missing_token_mapping"))})


def best_trades(
    priced: DataFrame,
    keys: Sequence[str],
    ordinal: Sequence[str],
    min_price: float = 0.0,
    max_price: float = 1.0,
    min_edge: float = 0.0,
    taker_bps: float = 30.0,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per decision: the first outcome with the greatest positive edge, and why there
    is none.

    Input: outcome_label, fair_probability, market_price, executable_price,
    coverage_status. Result has ``outcome`` traded / stale_price / missing_price /
    non_positive_edge / execution_filter.
    """
    ok = F.col("coverage_status") == "ok"
    p = F.col("executable_price")
    eligible = ok & (p >= min_price) & (p <= max_price)
    value = F.when(eligible, F.col("fair_probability") - p - fee(p, taker_bps))
    rows = priced.withColumn("edge", value)
    take = (F.col("edge") >= min_edge) & (F.col("edge") > 0)
    order = F.when(take, F.struct(F.col("edge"), *[(-F.col(c)).alias(f"__o{i}") for i, c in enumerate(ordinal)]))
    kept = F.struct("outcome_label", "fair_probability", "market_price", "executable_price", "edge", *carry)
    per = rows.groupBy(*keys).agg(
        F.max_by(kept, order).alias("__best"),
        F.bool_or(ok).alias("__covered"),
        F.bool_or(F.col("coverage_status") == "stale").alias("__stale"),
        F.bool_or(eligible).alias("__eligible"),
        F.bool_or(F.col("edge") > 0).alias("__positive"),
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    outcome = (
        F.when(~yes("__covered"), F.when(yes("__stale"), "stale_price").otherwise("missing_price"))
        .when(F.col("__best").isNotNull(), "traded")
        .when(yes("__eligible") & ~yes("__positive"), "non_positive_edge")
        .otherwise("execution_filter")
    )
    fields = ["outcome_label", "fair_probability", "market_price", "executable_price", "edge", *carry]
    return per.select(*keys, outcome.alias("outcome"), *[F.col(f"__best.{f}").alias(f) for f in fields])


def edge_scan(
    df: DataFrame,
    min_prob: float = 0.02,
    max_prob: float = 0.98,
    min_price: float = 0.0,
    max_price: float = 1.0,
    min_edge: float = 0.05,
    min_market_price: float = 0.0,
    max_no_price: float = 1.0,
    taker_bps: float = 30.0,
) -> DataFrame:
    """Yes and no edge of every outcome; the better one must reach ``min_edge``."""
    p, q = F.col("market_price"), F.col("model_prob")
    inside = (q >= min_prob) & (q <= max_prob) & (p > 0) & (p < 1) & (p >= min_price) & (p <= max_price)
    if min_market_price > 0:
        inside = inside & (p >= min_market_price) & (1.0 - p >= min_market_price)
    out = df.where(inside).withColumns(
        {"yes_edge": q - p - fee(p, taker_bps), "no_edge": (1.0 - q) - (1.0 - p) - fee(1.0 - p, taker_bps)}
    )
    out = out.withColumn("best_edge", F.greatest("yes_edge", "no_edge")).withColumn(
        "direction", F.when(F.col("yes_edge") >= F.col("no_edge"), "yes").otherwise("no")
    )
    keep = F.abs("best_edge") >= min_edge
    if max_no_price < 1.0:
        keep = keep & ((F.col("direction") == "yes") | (p <= max_no_price))
    return out.where(keep)


def two_sided_quotes(
    df: DataFrame,
    keys: Sequence[str],
    ordinal: Sequence[str],
    half_spread: float = 0.02,
    skew_factor: float = 0.5,
    base_size: float = 10.0,
    max_position: float = 100.0,
    max_orders: int = 20,
) -> DataFrame:
    """Bid and ask per outcome, shifted against inventory and sized by headroom.

    Each quote uses two orders of the cycle's budget, in label order, and the
    budget may be overdrawn by the last quote.
    """
    from pyspark.sql.window import Window

    limit = max(max_position, 1e-6)
    net = F.coalesce(F.col("net_position"), F.lit(0.0))
    skew = net * skew_factor / limit
    clamp = lambda c: F.greatest(F.least(c, F.lit(0.99)), F.lit(0.01))
    out = df.where(F.col("token_id").isNotNull()).withColumns(
        {
            "__bid": clamp(F.col("fair_probability") - half_spread - skew),
            "__ask": clamp(F.col("fair_probability") + half_spread - skew),
            "__size": base_size * F.greatest(1.0 - F.abs(net) / limit, F.lit(0.0)),
        }
    )
    crossed = F.col("__bid") >= F.col("__ask")
    middle = (F.col("__bid") + F.col("__ask")) / 2.0
    quotes = out.where(F.col("__size") > 0).select(
        *df.columns,
        F.round(F.when(crossed, F.greatest(middle - 0.005, F.lit(0.01))).otherwise(F.col("__bid")), 4).alias("bid_price"),
        F.round(F.when(crossed, F.least(middle + 0.005, F.lit(0.99))).otherwise(F.col("__ask")), 4).alias("ask_price"),
        F.round("__size", 2).alias("size"),
    )
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*ordinal))
    return quotes.withColumn("__n", place).where(F.col("__n") <= (max_orders + 1) // 2).drop("__n")


def forecast_exits(positions: DataFrame, probs: DataFrame, keys: Sequence[str], buffer: float) -> DataFrame:
    """Positions whose held outcome is now less likely than the buffer (absent = 0)."""
    joined = positions.join(probs, list(keys), "left")
    return joined.where(F.coalesce(F.col("prob"), F.lit(0.0)) < buffer)


def mispricings(df: DataFrame, min_gap: float = 0.02) -> DataFrame:
    """Outcomes whose probability is off the best ask by more than ``min_gap``."""
    off = df.withColumn("mispricing", F.col("fair_probability") - F.col("best_ask"))
    return off.where(F.abs("mispricing") > min_gap)


def top_outcomes(df: DataFrame, keys: Sequence[str], ordinal: Sequence[str], k: int = 3) -> DataFrame:
    """The ``k`` likeliest outcomes per market as one ordered array."""
    from skyledger.operators.reports import top_per_group

    best = top_per_group(df, keys, [F.desc("fair_probability"), *[F.asc(c) for c in ordinal]], k)
    entry = F.struct((-F.col("fair_probability")).alias("n"), *ordinal, F.col("outcome_label").alias("label"))
    ordered = F.sort_array(F.collect_list(entry))
    return best.groupBy(*keys).agg(
        F.transform(ordered, lambda e: F.struct(e["label"].alias("label"), (-e["n"]).alias("prob"))).alias("top_outcomes")
    )


def risk_flags(
    truth_track: Column, eligible: Column, reason: Column, age_minutes: Column, stale_minutes: float, impossible_mass: Column
) -> Column:
    """Review flags of an observation-driven opportunity, in a fixed order."""
    return F.array_compact(
        F.array(
            F.when(F.coalesce(truth_track, F.lit("")) != "exact_public", "research_public"),
            F.when(~eligible, "settlement_ineligible"),
            F.when(age_minutes.isNull(), "missing_observation").when(age_minutes > stale_minutes, "stale_observation"),
            F.when(reason == "after_cost_positive_but_spread_too_wide", "wide_spread")
            .when(reason == "after_cost_positive_but_liquidity_too_low", "low_liquidity")
            .when(reason == "after_cost_positive_but_below_threshold", "below_edge_threshold")
            .when(reason == "missing_book", "missing_book"),
            F.when(F.coalesce(impossible_mass, F.lit(0.0)) <= 0, "no_observation_dislocation"),
        )
    )


def queue_state(reason: Column, flags: Column) -> Column:
    """blocked, tradable or manual_review from the reason and its flags."""
    has = lambda *names: F.arrays_overlap(flags, F.array(*[F.lit(n) for n in names]))
    reviewable = reason.isin(
        "tradable",
        "after_cost_positive_but_spread_too_wide",
        "after_cost_positive_but_liquidity_too_low",
        "after_cost_positive_but_below_threshold",
    )
    return (
        F.when(has("missing_observation", "missing_book"), "blocked")
        .when((reason == "tradable") & ~has("research_public", "stale_observation"), "tradable")
        .when(reviewable, "manual_review")
        .otherwise("blocked")
    )


def approval_token(market_id: Column, label: Column, observed_at: Column, station: Column) -> Column:
    """First 16 hex digits of the hash of a candidate's identity; null when incomplete."""
    text = F.concat_ws("|", market_id, label, observed_at, F.coalesce(station, F.lit("")))
    return F.when(label.isNotNull() & observed_at.isNotNull(), F.substring(F.sha2(text, 256), 1, 16))


# Points of the listing-priority score.
AGE_POINTS = ((6, 40.0), (24, 32.0), (48, 20.0))
OLD_POINTS, UNKNOWN_AGE_POINTS = 8.0, -8.0
VOLUME_POINTS = ((500, 12.0), (2_000, 9.0), (10_000, 4.0))
LARGE_VOLUME_POINTS, UNKNOWN_VOLUME_POINTS = -2.0, 2.0


def priority_bucket(age_hours: Column, reason: Column, core: Column) -> Column:
    fresh = F.when(reason == "after_cost_positive_but_spread_too_wide", "fresh_listing_spread_blocked").otherwise("fresh_listing")
    return (
        F.when(age_hours.isNull(), "unknown_open_time")
        .when(age_hours <= 24, fresh)
        .when(core, "mature_core")
        .otherwise("mature_expansion")
    )


def priority_score(age_hours: Column, distance: Column, volume: Column, reason: Column, raw_gap: Column, cost_edge: Column) -> Column:
    """Points for a young listing, a far target, thin volume, the reason and the edges."""
    age = F.when(age_hours.isNull(), UNKNOWN_AGE_POINTS)
    for limit, points in AGE_POINTS:
        age = age.when(age_hours <= limit, points)
    size = F.when(volume.isNull(), UNKNOWN_VOLUME_POINTS)
    for limit, points in VOLUME_POINTS:
        size = size.when(volume <= limit, points)
    days = F.when(distance >= 2, 20.0).when(distance == 1, 10.0).when(distance == 0, 4.0).otherwise(0.0)
    why = (
        F.when(reason == "tradable", 18.0)
        .when(reason == "after_cost_positive_but_spread_too_wide", 14.0)
        .when(reason == "raw_gap_non_positive", 0.0)
        .otherwise(6.0)
    )
    clamped = lambda c, k, m: F.coalesce(F.greatest(F.least(c * k, F.lit(m)), F.lit(-m)), F.lit(0.0))
    return F.round(
        age.otherwise(OLD_POINTS)
        + days
        + size.otherwise(LARGE_VOLUME_POINTS)
        + why
        + clamped(raw_gap, 200.0, 10.0)
        + clamped(cost_edge, 400.0, 20.0),
        6,
    )


def candidate_alert(reason: Column, age_hours: Column, cost_edge: Column) -> Column:
    young_blocked = (reason == "after_cost_positive_but_spread_too_wide") & (age_hours <= 24.0)
    return F.coalesce(cost_edge > 0, F.lit(False)) | F.coalesce(young_blocked, F.lit(False))


def first_known_price(trades: DataFrame, primary: DataFrame, fallback: DataFrame, keys: Sequence[str], zero_is_missing: bool = False) -> DataFrame:
    """Latest price from the primary source, else the fallback, with its origin.

    ``zero_is_missing`` lets a primary price of exactly 0 fall through, as the
    settlement of the signal log does.
    """
    a = primary.select(*keys, F.col("price").alias("__a"))
    b = fallback.select(*keys, F.col("price").alias("__b"))
    j = trades.join(a, list(keys), "left").join(b, list(keys), "left")
    first = F.when(F.col("__a") != 0, F.col("__a")) if zero_is_missing else F.col("__a")
    return (
        j.withColumn("latest_price", F.coalesce(first, F.col("__b")))
        .withColumn("price_source", F.when(first.isNotNull(), "silver").when(F.col("__b").isNotNull(), "gamma_log"))
        .drop("__a", "__b")
    )


def watch_alerts(books: DataFrame, rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rules whose threshold the lowest current ask reaches, widest gap first."""
    low = books.groupBy(*keys).agg(F.min("best_ask").alias("best_ask"))
    hit = rules.join(low, list(keys)).where(F.col("best_ask") <= F.col("threshold"))
    return hit.withColumn("gap", F.col("threshold") - F.col("best_ask"))
