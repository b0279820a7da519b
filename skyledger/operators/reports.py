"""Coverage, readiness, log and gate reports, each from one aggregation pass.

Multi-level reports (overall, by city, by horizon, ...) label every row with
the groups it belongs to and aggregate once; partial aggregation keeps the
shuffle at one row per group and task, so a hot city costs no more than others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.operators.quantiles import grouped_quantiles, many_quantiles, null_safe_join
from skyledger.session import written

# Reasons that make a row a near miss, and those blamed on the spread.
NEAR_MISS_REASONS = (
    "fee_killed_edge",
    "slippage_killed_edge",
    "after_cost_positive_but_spread_too_wide",
    "after_cost_positive_but_liquidity_too_low",
    "after_cost_positive_but_below_threshold",
    "insufficient_depth",
)
SPREAD_REASONS = ("after_cost_positive_but_spread_too_wide", "slippage_killed_edge", "insufficient_depth")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def share(condition: Column) -> Column:
    """Share of rows meeting a condition; null conditions count as not met."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def leveled(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per input row and report level, with ``level`` and ``grp`` columns."""
    entries = []
    for name, cols in levels.items():
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in cols]
        grp = F.concat_ws(":", *parts) if parts else F.lit("all")
        entries.append(F.struct(F.lit(name).alias("level"), grp.alias("grp")))
    return df.select("*", F.inline(F.array(*entries)))


# --- gates -----------------------------------------------------------------


def path_gate(cycles: Column, evaluated: Column, raw_positive: Column, edge_positive: Column) -> Column:
    """GO / INCONCLUSIVE / NO_GO of one observed path, with its reason."""

    def verdict(decision: str, reason: str) -> Column:
        return F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("decision_reason"))

    return (
        F.when(F.coalesce(evaluated, F.lit(0)) <= 0, verdict("INCONCLUSIVE", "no_observations"))
        .when(edge_positive >= 2, verdict("GO", "repeated_after_cost_positive_edges"))
        .when(edge_positive == 1, verdict("INCONCLUSIVE", "single_after_cost_positive_edge"))
        .when(cycles <= 1, verdict("INCONCLUSIVE", "single_cycle_only"))
        .when(F.coalesce(raw_positive, F.lit(0)) <= 0, verdict("NO_GO", "raw_gap_never_positive"))
        .otherwise(verdict("NO_GO", "after_cost_edge_never_positive"))
    )


def revenue_gate(benchmark: Column, *paths: Column) -> Column:
    """Combine the benchmark decision with the decisions of the live paths."""

    def any_is(value: str) -> Column:
        return F.exists(F.array(*paths), lambda p: p == value)

    def verdict(decision: str, reason: str) -> Column:
        return F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("decision_reason"))

    all_stop = F.forall(F.array(*paths), lambda p: p == "NO_GO")
    return (
        F.when(benchmark == "NO_GO", verdict("NO_GO", "benchmark_no_go"))
        .when(F.coalesce(benchmark, F.lit("")) != "GO", verdict("INCONCLUSIVE", "benchmark_not_go"))
        .when(any_is("GO"), verdict("GO", "benchmark_go_with_live_path_confirmation"))
        .when(all_stop, verdict("NO_GO", "benchmark_go_but_live_paths_no_go"))
        .otherwise(verdict("INCONCLUSIVE", "benchmark_go_but_live_paths_inconclusive"))
    )


def profitability_gate(
    city_metrics: DataFrame,
    min_policy_trades: float,
    min_priced_rows: float,
    min_ok_ratio: float,
    min_city_trades: float,
) -> DataFrame:
    """Profitability decision over per-city metrics.

    Input columns: city, policy_trades, policy_pnl, priced_rows, panel_rows,
    panel_ok_rows. The sample must be large enough, then every city must pass
    coverage, trade count and non-negative result, then the total decides.
    """
    ratio = F.when(F.col("panel_rows") > 0, F.col("panel_ok_rows") / F.col("panel_rows")).otherwise(0.0)
    totals = city_metrics.agg(
        F.coalesce(F.sum("policy_trades"), F.lit(0)).cast("double").alias("policy_trades"),
        F.coalesce(F.sum("policy_pnl"), F.lit(0.0)).alias("policy_pnl"),
        F.coalesce(F.sum("priced_rows"), F.lit(0)).cast("double").alias("priced_rows"),
        F.when(F.sum("panel_rows") > 0, F.sum("panel_ok_rows") / F.sum("panel_rows")).otherwise(0.0).alias("ok_ratio"),
        F.bool_and(ratio >= min_ok_ratio).alias("coverage_ok"),
        F.bool_and(F.col("policy_trades") >= min_city_trades).alias("trades_ok"),
        F.bool_and(F.col("policy_pnl") >= 0).alias("pnl_ok"),
    )
    adequate = (
        (F.col("policy_trades") >= min_policy_trades)
        & (F.col("priced_rows") >= min_priced_rows)
        & (F.col("ok_ratio") >= min_ok_ratio)
    )
    reason = (
        F.when(~adequate, "insufficient_sample")
        .when(~F.col("coverage_ok"), "city_panel_coverage_inadequate")
        .when(~F.col("trades_ok"), "city_real_history_sample_inadequate")
        .when(~F.col("pnl_ok"), "city_real_history_negative_pnl")
        .when(F.col("policy_pnl") > 0, "positive_policy_pnl_real_history_with_city_gates")
        .otherwise("non_positive_policy_pnl_real_history")
    )
    decision = (
        F.when(F.col("decision_reason").startswith("positive"), "GO")
        .when(F.col("decision_reason").isin("city_real_history_negative_pnl", "non_positive_policy_pnl_real_history"), "NO_GO")
        .otherwise("INCONCLUSIVE")
    )
    return totals.withColumn("decision_reason", reason).withColumn("decision", decision)


def city_gates(city_metrics: DataFrame, min_city_trades: float, min_ok_ratio: float) -> DataFrame:
    """Pass flags per city; a city without a payload passes nothing."""
    ratio = F.when(F.col("panel_rows") > 0, F.col("panel_ok_rows") / F.col("panel_rows")).otherwise(0.0)
    flags = city_metrics.withColumn("panel_ok_ratio", ratio).withColumns(
        {
            "passes_panel_coverage": F.col("panel_ok_ratio") >= min_ok_ratio,
            "passes_trade_count": F.coalesce(F.col("policy_trades"), F.lit(0)) >= min_city_trades,
            "passes_non_negative_pnl": F.coalesce(F.col("policy_pnl"), F.lit(0.0)) >= 0,
        }
    )
    return flags.withColumn(
        "passes", F.col("passes_panel_coverage") & F.col("passes_trade_count") & F.col("passes_non_negative_pnl")
    )


def reduced_core_gate(city_metrics: DataFrame, min_cities: int, min_ok_ratio: float, **limits) -> DataFrame:
    """The profitability gate over cities that pass coverage; too few cities is inconclusive."""
    ratio = F.when(F.col("panel_rows") > 0, F.col("panel_ok_rows") / F.col("panel_rows")).otherwise(0.0)
    eligible = city_metrics.where(ratio >= min_ok_ratio)
    gate = profitability_gate(eligible, min_ok_ratio=min_ok_ratio, **limits)
    n = eligible.agg(F.count("*")).scalar()
    few = F.col("eligible_cities") < min_cities
    return (
        gate.withColumn("eligible_cities", n)
        .withColumn("decision", F.when(few, "INCONCLUSIVE").otherwise(F.col("decision")))
        .withColumn("decision_reason", F.when(few, "too_few_coverage_eligible_cities").otherwise(F.col("decision_reason")))
    )


# --- opportunity / observation / listing logs ------------------------------


def log_summary(
    log: DataFrame,
    levels: Mapping[str, Sequence[str]],
    medians: Mapping[str, str] | None = None,
    extra: Sequence[Column] = (),
    cycle: str = "observed_at",
) -> DataFrame:
    """Counts, best values, exact medians and the path gate for every level and group."""
    rows = leveled(log, levels)
    out = rows.groupBy("level", "grp").agg(
        F.count_distinct(cycle).alias("cycles"),
        F.count("*").alias("markets_evaluated"),
        count_if(F.col("reason") == "tradable").alias("tradable_count"),
        count_if(F.col("raw_gap") > 0).alias("raw_gap_positive_count"),
        count_if(F.col("after_cost_edge") > 0).alias("after_cost_edge_positive_count"),
        F.max("raw_gap").alias("best_raw_gap"),
        F.max("after_cost_edge").alias("best_after_cost_edge"),
        *extra,
    )
    gate = path_gate(
        F.col("cycles"),
        F.col("markets_evaluated"),
        F.col("raw_gap_positive_count"),
        F.col("after_cost_edge_positive_count"),
    )
    out = out.withColumn("__gate", gate).select(
        "*", F.col("__gate.decision").alias("gate_decision"), F.col("__gate.decision_reason").alias("gate_reason")
    ).drop("__gate")
    if medians:
        found = many_quantiles(rows, ["level", "grp"], {c: {name: 0.5} for c, name in medians.items()})
        out = null_safe_join(out, found, ["level", "grp"])
    return out


def nested_counts(df: DataFrame, group: str, item: str, as_map: bool = False) -> DataFrame:
    """Counts per group and item; optionally one map per group (items are a fixed domain)."""
    counts = df.groupBy(
        F.coalesce(F.col(group).cast("string"), F.lit("unknown")).alias("grp"),
        F.coalesce(F.col(item).cast("string"), F.lit("unknown")).alias("item"),
    ).agg(F.count("*").alias("n"))
    if not as_map:
        return counts
    entries = F.sort_array(F.collect_list(F.struct("item", "n")))
    return counts.groupBy("grp").agg(F.map_from_entries(entries).alias("counts"))


def flag_counts(df: DataFrame, levels: Mapping[str, Sequence[str]], flags: str) -> DataFrame:
    """Counts of every flag of an array column per level and group."""
    return (
        leveled(df, levels)
        .select("level", "grp", F.explode(flags).alias("flag"))
        .groupBy("level", "grp", "flag")
        .agg(F.count("*").alias("n"))
    )


def top_rows(
    df: DataFrame,
    limit: int,
    sort: Sequence[Column],
    reasons: Sequence[str] | None = None,
    zero_as_missing: Sequence[str] = (),
) -> DataFrame:
    """The first ``limit`` rows of a fixed order, optionally among some reasons.

    ``zero_as_missing`` reproduces reports that rank a score of exactly 0.0
    behind all others.
    """
    picked = df if reasons is None else df.where(F.col("reason").isin(*reasons))
    for c in zero_as_missing:
        picked = picked.withColumn(f"__rank_{c}", F.when(F.col(c) != 0, F.col(c)))
    return picked.orderBy(*sort).limit(limit).drop(*[f"__rank_{c}" for c in zero_as_missing])


def blocker_watchlist(df: DataFrame, group: str, reason: str, limit: int = 10) -> DataFrame:
    """Groups ranked by how many of their rows one reason blocks."""
    out = (
        df.groupBy(F.coalesce(F.col(group), F.lit("unknown")).alias(group))
        .agg(count_if(F.col("reason") == reason).alias("blocked"), F.count("*").alias("evaluation_rows"))
        .where(F.col("blocked") > 0)
        .withColumn("ratio", F.round(F.col("blocked") / F.col("evaluation_rows"), 6))
    )
    return out.orderBy(F.col("blocked").desc(), F.col("ratio").desc_nulls_last(), group).limit(limit)


def signal_rollup(df: DataFrame) -> DataFrame:
    """Edge statistics of a signal report; zero where there are no edges."""
    return df.agg(
        F.count("*").alias("row_count"),
        count_if(F.col("reason") == "tradable").alias("tradable_count"),
        F.count("edge").alias("edge_count"),
        count_if(F.col("edge") > 0).alias("positive_count"),
        F.coalesce(F.max("edge"), F.lit(0.0)).alias("max_edge"),
        F.coalesce(F.avg("edge"), F.lit(0.0)).alias("mean_edge"),
    )


def sum_maps(df: DataFrame, column: str) -> DataFrame:
    """Sum a map column entry by entry."""
    return df.select(F.explode(column).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))


def panel_coverage_total(rows: DataFrame, coverage: str = "coverage", total: str = "rows") -> DataFrame:
    """Sum coverage maps over cities, with the share of fresh rows."""
    summed = sum_maps(rows, coverage)
    counts = summed.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "total")))).alias("coverage"))
    n = rows.agg(F.coalesce(F.sum(total), F.lit(0))).scalar()
    ok = F.coalesce(F.element_at("coverage", F.lit("ok")), F.lit(0))
    return counts.withColumn("rows", n).withColumn(
        "ok_ratio", F.when(F.col("rows") > 0, ok / F.col("rows")).otherwise(0.0)
    )


# --- coverage and readiness --------------------------------------------------


def truth_coverage(truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    return truth.groupBy(*keys).agg(F.count("*").alias("count"))


def with_lag_days(truth: DataFrame, target: str, latest: str) -> DataFrame:
    return truth.withColumn("lag_days", F.datediff(target, latest))


def readiness_details(markets: DataFrame, forecast: DataFrame, truth: DataFrame, observed: DataFrame, gold: DataFrame, latest_truth_order: Sequence[Column]) -> DataFrame:
    """Forecast, truth and gold counts per market with a readiness status.

    Every side is aggregated to one row per market before it is joined.
    """
    f = forecast.groupBy("market_id").agg(
        F.count("*").alias("forecast_row_count"), F.count_distinct("model_name").alias("forecast_model_count")
    )
    newest = Window.partitionBy("market_id").orderBy(*latest_truth_order)
    t = (
        truth.withColumn("__rn", F.row_number().over(newest))
        .where(F.col("__rn") == 1)
        .select("market_id", F.col("status").alias("truth_status"))
    )
    o = observed.groupBy("market_id").agg(F.count("*").alias("truth_daily_count"))
    g = gold.groupBy("market_id").agg(
        F.count("*").alias("gold_row_count"), F.count_distinct("decision_horizon").alias("gold_horizon_count")
    )
    out = markets
    for side in (f, t, o, g):
        out = out.join(side, "market_id", "left")
    counts = ["forecast_row_count", "forecast_model_count", "truth_daily_count", "gold_row_count", "gold_horizon_count"]
    out = out.fillna(0, subset=counts)
    status = (
        F.when(F.col("gold_row_count") > 0, "ready")
        .when(F.col("truth_status") == "lag", "truth_lag")
        .when(F.col("truth_status") == "error", "truth_error")
        .when(F.col("forecast_row_count") <= 0, "missing_forecast")
        .when(F.col("truth_daily_count") <= 0, "missing_truth")
        .otherwise("gold_missing")
    )
    return out.withColumn("readiness_status", status)


def readiness_summary(details: DataFrame, key: str = "city") -> DataFrame:
    return details.groupBy(key).agg(
        F.count("*").alias("snapshot_count"),
        count_if(F.col("forecast_row_count") > 0).alias("forecast_ready_count"),
        count_if(F.col("truth_daily_count") > 0).alias("truth_ok_count"),
        count_if(F.col("truth_status") == "lag").alias("truth_lag_count"),
        count_if(F.col("truth_status") == "error").alias("truth_error_count"),
        count_if(F.col("gold_row_count") > 0).alias("gold_market_count"),
        F.sum("gold_row_count").alias("gold_row_count"),
    )


def panel_summary(panel: DataFrame, keys: Sequence[str] = ("city", "decision_horizon")) -> DataFrame:
    """Token and market counts by coverage status."""
    return panel.groupBy(*keys, "coverage_status").agg(
        F.count("*").alias("token_count"), F.count_distinct("market_id").alias("market_count")
    )


def market_summary(panel: DataFrame, keys: Sequence[str] = ("city", "market_id", "decision_horizon")) -> DataFrame:
    """Per-market status counts; a market is ready with at least one fresh token."""
    status = F.col("coverage_status")
    return panel.groupBy(*keys).agg(
        F.count("*").alias("token_count"),
        *[count_if(status == s).alias(f"{s}_token_count") for s in ("ok", "stale", "missing")],
        (count_if(status == "ok") > 0).alias("market_ready"),
    )


def decision_readiness(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Decision rows, and those whose every token is fresh."""
    per = market_summary(panel, keys)
    full = (F.col("ok_token_count") == F.col("token_count")) & (F.col("token_count") > 0)
    return per.agg(F.count("*").alias("decision_rows"), count_if(full).alias("ready_rows"))


def coverage_by_group(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Status counts and fresh share per group."""
    status = F.col("coverage_status")
    out = panel.groupBy(*keys).agg(
        F.count("*").alias("rows"), *[count_if(status == s).alias(s) for s in ("ok", "stale", "missing")]
    )
    return out.withColumn("ok_ratio", F.col("ok") / F.col("rows"))


def price_request_summary(requests: DataFrame, keys: Sequence[str] = ("status", "city")) -> DataFrame:
    """Request counts, points and last-trade findings per status and city."""
    reason = F.coalesce(F.col("empty_reason"), F.lit(""))
    present = "history_unavailable_last_trade_present"
    absent = "history_unavailable_last_trade_missing"
    yes = F.lower(F.trim(F.col("last_trade_present").cast("string"))).isin("true", "1", "1.0", "yes", "y")
    return requests.groupBy(*keys).agg(
        F.count("*").alias("request_count"),
        F.count_distinct("market_id").alias("market_count"),
        F.sum("point_count").alias("total_points"),
        F.count("last_trade_present").alias("last_trade_probe_count"),
        count_if(yes).alias("last_trade_present_count"),
        count_if(reason == present).alias("history_empty_with_last_trade_count"),
        count_if(reason == absent).alias("history_empty_without_last_trade_count"),
        count_if(reason.startswith("history_unavailable_last_trade_") & ~reason.isin(present, absent)).alias(
            "history_empty_last_trade_error_count"
        ),
    )


def forecast_availability(requests: DataFrame) -> DataFrame:
    """Available, unavailable and failed requests per model and endpoint."""
    status = F.coalesce(F.col("availability_status"), F.lit("unknown"))
    out = requests.groupBy(
        "city",
        "model_name",
        "endpoint_kind",
        "request_kind",
        F.coalesce("decision_horizon", F.lit("generic")).alias("decision_horizon"),
    ).agg(
        F.count("market_id").alias("requests"),
        count_if(status.isin("available", "demo_fixture")).alias("available_requests"),
        count_if(status == "unavailable").alias("unavailable_requests"),
        count_if(status == "error").alias("error_requests"),
        F.max("requested_at").alias("last_requested_at"),
    )
    return out.withColumn(
        "availability_ratio", F.col("available_requests") / F.greatest(F.col("requests"), F.lit(1))
    )


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per group; Spark prunes to k rows per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")


def recommended_models(availability: DataFrame, top_k: int = 3) -> DataFrame:
    usable = availability.where(
        F.col("request_kind").isin("full", "single_run") & (F.col("available_requests") > 0)
    )
    order = [F.desc("availability_ratio"), F.desc("available_requests"), F.asc("model_name")]
    return top_per_group(usable, ["city", "decision_horizon"], [*order, F.asc("endpoint_kind"), F.asc("request_kind")], top_k)


def empty_build_diagnostics(hourly: DataFrame) -> DataFrame:
    """Why present forecasts gave no training rows: null, zero and undated groups."""
    on_day = F.col("local_date") == F.col("target_local_date")
    temp = F.when(on_day, F.col("temperature_2m"))
    groups = hourly.groupBy("market_id", "endpoint_kind", "decision_horizon").agg(
        F.count("*").alias("rows"),
        F.count(temp).alias("present"),
        F.max(F.abs(temp)).alias("largest"),
        F.count("issue_time_utc").alias("dated"),
    )
    return groups.agg(
        F.sum("rows").alias("rows"),
        F.count("*").alias("groups"),
        count_if(F.col("present") > 0).alias("nonnull_target_groups"),
        count_if(F.col("present") == 0).alias("all_null_target_groups"),
        count_if(F.col("largest") <= 1e-9).alias("all_zero_target_groups"),
        count_if((F.col("endpoint_kind") == "historical_forecast") & (F.col("dated") == 0)).alias(
            "historical_missing_issue_groups"
        ),
    )


def lagged_stations(truth: DataFrame, order: Sequence[Column], limit: int = 3) -> DataFrame:
    """The first few stations whose truth archive lags."""
    latest = F.date_format("latest_available_date", "yyyy-MM-dd")
    text = F.when(latest.isNotNull(), F.concat(F.lit("latest "), latest)).otherwise("archive lag")
    return truth.where(F.col("status") == "lag").orderBy(*order).limit(limit).withColumn("lag_note", text)


# --- trades ------------------------------------------------------------------


def trade_summary(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count, result, hit rate and mean edge; zeros for an empty log."""
    out = trades.groupBy(*keys).agg(
        F.count("*").alias("num_trades"),
        F.coalesce(F.sum("realized_pnl"), F.lit(0.0)).alias("pnl"),
        F.coalesce(share(F.col("realized_pnl") > 0), F.lit(0.0)).alias("hit_rate"),
        F.coalesce(F.avg("edge"), F.lit(0.0)).alias("avg_edge"),
        F.avg("price").alias("avg_price"),
    )
    return out


def trade_report(trades: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rich trade summary with the exact median edge for every level and group."""
    # read by the summary and by each pass of the median, so what makes the trades runs once
    used = dict.fromkeys(["realized_pnl", "price", "edge", "price_age_seconds", *[c for cols in levels.values() for c in cols]])
    rows = leveled(written(trades.select(*used), "report-trades"), levels)
    pnl = F.coalesce(F.col("realized_pnl"), F.lit(0.0))
    out = rows.groupBy("level", "grp").agg(
        F.count("*").alias("trades"),
        F.sum(pnl).alias("pnl"),
        F.avg(pnl).alias("pnl_per_trade"),
        share(pnl > 0).alias("hit_rate"),
        F.avg("price").alias("avg_price"),
        F.avg("edge").alias("avg_edge"),
        (F.avg("price_age_seconds") / 60.0).alias("avg_price_age_min"),
    )
    med = grouped_quantiles(rows, ["level", "grp"], "edge", {"median_edge": 0.5})
    return null_safe_join(out, med, ["level", "grp"])


def cut(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed buckets, the lowest edge included; outside values are null."""
    out = F.when((value >= edges[0]) & (value <= edges[1]), labels[0])
    for low, high, label in zip(edges[1:-1], edges[2:], labels[1:]):
        out = out.when((value > low) & (value <= high), label)
    return out


def price_band(value: Column, edges: Sequence[float]) -> Column:
    """Left-closed buckets ``[lo, hi)`` as text."""
    out = F.lit(None).cast("string")
    for low, high in reversed(list(zip(edges[:-1], edges[1:]))):
        out = F.when((value >= low) & (value < high), f"{low:g}-{high:g}").otherwise(out)
    return out


def accuracy_by(df: DataFrame, key: Column, correct: Column, min_rows: int = 0) -> DataFrame:
    out = df.groupBy(key.alias("bucket")).agg(F.count("*").alias("n"), share(correct).alias("accuracy"))
    return out.where((F.col("n") >= min_rows) & F.col("bucket").isNotNull())


def filter_grid(
    trades: DataFrame,
    min_edges: Sequence[float],
    min_prices: Sequence[float],
    max_prices: Sequence[float],
    min_trades: int = 5,
    limit: int | None = 30,
) -> DataFrame:
    """Result of every (min edge, min price, max price) filter combination.

    A trade passes the first i edge and j price floors and all ceilings from
    index k on, so trades are first summed per (i, j, k) cell. Only those cells
    meet the grid, never the trades.
    """

    def passed(value: Column, floors: Sequence[float]) -> Column:
        return sum((F.when(value >= f, 1).otherwise(0) for f in floors), F.lit(0))

    pnl = F.coalesce(F.col("realized_pnl"), F.lit(0.0))
    cells = (
        trades.where(F.col("edge").isNotNull() & F.col("price").isNotNull())
        .groupBy(
            passed(F.col("edge"), min_edges).alias("i"),
            passed(F.col("price"), min_prices).alias("j"),
            sum((F.when(F.col("price") > m, 1).otherwise(0) for m in max_prices), F.lit(0)).alias("k"),
        )
        .agg(
            F.count("*").alias("n"),
            F.sum(pnl).alias("pnl"),
            count_if(pnl > 0).alias("hits"),
            F.sum("edge").alias("edge"),
            F.sum("price").alias("price"),
        )
        .where((F.col("i") > 0) & (F.col("j") > 0) & (F.col("k") < len(max_prices)))
    )
    pick = lambda values, low, high: F.explode(F.slice(F.array(*[F.lit(float(v)) for v in values]), low, high))
    grid = (
        cells.withColumn("min_edge", pick(min_edges, F.lit(1), F.col("i")))
        .withColumn("min_price", pick(min_prices, F.lit(1), F.col("j")))
        .withColumn("max_price", pick(max_prices, F.col("k") + 1, F.lit(len(max_prices))))
        .groupBy("min_edge", "min_price", "max_price")
        .agg(
            F.sum("n").alias("trades"),
            F.sum("pnl").alias("pnl"),
            (F.sum("pnl") / F.sum("n")).alias("pnl_per_trade"),
            (F.sum("hits") / F.sum("n")).alias("hit_rate"),
            (F.sum("edge") / F.sum("n")).alias("avg_edge"),
            (F.sum("price") / F.sum("n")).alias("avg_price"),
        )
        .where(F.col("trades") >= min_trades)
    )
    if limit is None:
        return grid
    return grid.orderBy(
        F.round("pnl", 6).desc(), F.round("pnl_per_trade", 6).desc(), "min_edge", "min_price", "max_price"
    ).limit(limit)


def weighted_average(value: str, weight: str) -> Column:
    """Average weighted by positive weights only; 0 where none is positive."""
    w = F.when(F.col(weight) > 0, F.col(weight))
    return F.coalesce(F.sum(F.coalesce(F.col(value), F.lit(0.0)) * w) / F.sum(w), F.lit(0.0))


def aggregate_backtests(rows: DataFrame) -> DataFrame:
    """Sum per-city back-test metrics; rates are weighted by trades."""
    return rows.agg(
        F.sum("num_trades").alias("num_trades"),
        F.sum("pnl").alias("pnl"),
        F.sum("priced_decision_rows").alias("priced_decision_rows"),
        weighted_average("hit_rate", "num_trades").alias("hit_rate"),
        weighted_average("avg_edge", "num_trades").alias("avg_edge"),
        weighted_average("avg_price_age_seconds", "priced_decision_rows").alias("avg_price_age_seconds"),
    )


def l2_buckets(l2: DataFrame, edges: Sequence[int] = (48, 24, 12, 6, 3, 1)) -> DataFrame:
    """Depth and spread by hours to settlement; empty buckets are kept.

    Buckets are ``(lower, upper]`` and the median is the upper one.
    """
    spark = l2.sparkSession
    bounds = spark.createDataFrame([(int(u),) for u in edges], "upper int")
    below = F.lag("upper", 1, 0).over(Window.orderBy("upper"))
    bounds = bounds.withColumn("lower", below).withColumn(
        "bucket", F.concat(F.col("lower").cast("string"), F.lit("-"), F.col("upper").cast("string"), F.lit("h"))
    )
    hours = F.col("hours_to_settlement")
    upper = F.lit(None).cast("int")
    ordered = sorted(edges)
    for low, high in reversed(list(zip([0, *ordered[:-1]], ordered))):
        upper = F.when((hours > low) & (hours <= high), high).otherwise(upper)
    marked = l2.withColumn("upper", upper).where(F.col("upper").isNotNull())
    stats = marked.groupBy("upper").agg(
        F.count("*").alias("count"),
        F.avg("bid_depth").alias("mean_bid_depth"),
        F.avg("ask_depth").alias("mean_ask_depth"),
        (share(F.col("spread") < 0.10) * 100).alias("tradeable_pct"),
    )
    med = grouped_quantiles(marked, ["upper"], "spread", {"median_spread": 0.5}, method="upper")
    out = bounds.join(stats, "upper", "left").join(med, "upper", "left")
    return out.fillna(0, subset=["count"]).drop("upper", "lower")


# --- errors, folds, tiers -----------------------------------------------------


def error_summary(df: DataFrame, forecast: str, actual: str, keys: Sequence[str] = ()) -> DataFrame:
    """Bias, MAE, RMSE and exact p95 / p99 of the absolute error per group."""
    valid = df.where(F.col(forecast).isNotNull() & F.col(actual).isNotNull()).withColumn(
        "__e", F.col(forecast) - F.col(actual)
    ).withColumn("__a", F.abs("__e"))
    out = valid.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.avg("__e").alias("bias"),
        F.avg("__a").alias("mae"),
        F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse"),
    )
    wanted = {"p95_abs_error": 0.95, "p99_abs_error": 0.99}
    found = grouped_quantiles(valid, keys, "__a", wanted)
    if keys:
        return null_safe_join(out, found, keys)
    return out.select("*", *[found.select(n).scalar().alias(n) for n in wanted])


def macro_mae(per_group: DataFrame) -> DataFrame:
    return per_group.agg(F.avg("mae").alias("macro_mae"), F.count("*").alias("group_count"),
                         F.min("mae").alias("min_mae"), F.max("mae").alias("max_mae"))


def city_tiers(df: DataFrame, key: str, min_rows: int, cap: float) -> DataFrame:
    """Rows per city, tier and exposure weight ``min(1, cap * total / rows)``."""
    counts = df.groupBy(key).agg(F.count("*").alias("rows"))
    total = df.agg(F.count("*")).scalar()
    return counts.withColumn(
        "tier", F.when(F.col("rows") >= min_rows, "primary").otherwise("exploratory")
    ).withColumn("weight", F.round(F.least(F.lit(1.0), F.lit(cap) * total / F.col("rows")), 6))


def frame_signature(df: DataFrame, date: str, market: str, horizon: str) -> DataFrame:
    """Row, date and horizon facts of a table and their SHA-256."""
    horizons = df.groupBy(horizon).agg(F.count("*").alias("n")).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct(horizon, "n"))), lambda s: F.concat_ws("=", s[horizon], s["n"])),
            ",",
        )
    )
    facts = df.agg(
        F.count("*").alias("rows"),
        F.date_format(F.min(date), "yyyy-MM-dd").alias("min_date"),
        F.date_format(F.max(date), "yyyy-MM-dd").alias("max_date"),
        F.count_distinct(date).alias("dates"),
        F.count_distinct(market).alias("markets"),
    ).withColumn("horizons", horizons.scalar())
    text = F.concat_ws("|", F.lit(str(len(df.columns))), *[F.col(c).cast("string") for c in ("rows", "min_date", "max_date", "dates", "markets", "horizons")])
    return facts.withColumn("signature", F.sha2(text, 256))
