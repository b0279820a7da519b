"""Date islands, work queues, shards, run detection and watchlists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.operators.asof import SLICE_ROWS, cut_hot_slices, time_slice
from skyledger.operators.folds import global_ordinal
from skyledger.operators.reports import count_if


def date_ranges(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Ranges of consecutive dates per key. Dates are made distinct first, so a
    window holds at most the days of the calendar."""
    days = df.where(F.col(date).isNotNull()).select(*keys, F.to_date(date).alias("__d")).distinct()
    order = Window.partitionBy(*keys).orderBy("__d") if keys else Window.partitionBy(F.lit(0)).orderBy("__d")
    island = F.date_sub("__d", F.row_number().over(order))
    return (
        days.withColumn("__i", island)
        .groupBy(*keys, "__i")
        .agg(F.min("__d").alias("start_date"), F.max("__d").alias("end_date"), F.count("*").alias("days"))
        .drop("__i")
    )


def count_ranges(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Ranges of consecutive dates that share one row count per day."""
    per = df.where(F.col(date).isNotNull()).groupBy(*keys, F.to_date(date).alias("__d")).agg(F.count("*").alias("count"))
    w = Window.partitionBy(*keys, "count").orderBy("__d")
    return (
        per.withColumn("__i", F.date_sub("__d", F.row_number().over(w)))
        .groupBy(*keys, "count", "__i")
        .agg(F.min("__d").alias("start_date"), F.max("__d").alias("end_date"))
        .drop("__i")
    )


def first_incomplete_date(df: DataFrame, date: str, unit: str, anchor: str, full: Column) -> DataFrame:
    """First day from ``anchor`` on whose distinct units are not complete.

    Complete days from the anchor form one island; the day after it is wanted.
    """
    start = F.lit(anchor).cast("date")
    per = df.groupBy(F.to_date(date).alias("__d")).agg(F.count_distinct(unit).alias("__n"))
    complete = per.where((F.col("__d") >= start) & (F.col("__n") == full))
    run = complete.withColumn("__i", F.datediff("__d", start) - F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__d")) + 1)
    return run.where(F.col("__i") == 0).agg(F.coalesce(F.date_add(F.max("__d"), 1), start).alias("next_date"))


def work_list(stations: DataFrame, station: str, start: str, end: str) -> DataFrame:
    """Every distinct station with every date of a range."""
    dates = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return stations.select(station).distinct().withColumn("work_date", F.explode(dates))


def dates_of_ranges(df: DataFrame, text: str) -> DataFrame:
    """Single dates from texts such as ``2024-01-01..2024-01-03, 2024-02-01``."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"(\d{4}-\d{2}-\d{2}(?:\.\.\d{4}-\d{2}-\d{2})?)"), 1)
    parts = df.withColumn("__r", F.explode(found))
    first = F.substring("__r", 1, 10).cast("date")
    last = F.when(F.length("__r") > 10, F.substring("__r", 13, 10).cast("date")).otherwise(first)
    return parts.where(first <= last).withColumn("date", F.explode(F.sequence(first, last))).drop("__r")


def latest_entry(log: DataFrame, keys: Sequence[str], outcome: str, allowed: Sequence[str], order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Latest log entry per key among the allowed outcomes."""
    kept = log.where(F.col(outcome).isin(*allowed))
    return kept.groupBy(*keys).agg(F.max_by(F.struct(outcome, *carry), F.struct(*order)).alias("__e")).select(*keys, "__e.*")


def bucket_edges(df: DataFrame, upper: str) -> DataFrame:
    """Lower edge of every bucket from the next smaller upper edge (0 for the last)."""
    return df.withColumn("lower", F.coalesce(F.lead(upper).over(Window.partitionBy(F.lit(0)).orderBy(F.desc(upper))), F.lit(0)))


def with_previous(df: DataFrame, keys: Sequence[str], time: str, value: str, into: str, sequence: Sequence[str] = (), slice_seconds: int = 86_400, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Value of the previous row of the key, carried over time slices so that a hot
    key is spread over many tasks; a slice of more than ``slice_rows`` rows is cut further."""
    keys = list(keys)
    rows = df.withColumn("__slice", time_slice(F.col(time), slice_seconds)).withColumn("__at", F.col(time))
    rows = cut_hot_slices([rows], keys, slice_rows)[0].drop("__at").withColumn("__real", F.lit(1))
    closing = rows.groupBy(*keys, "__slice").agg(F.max_by(value, F.struct(time, *sequence)).alias("__last"))
    before = Window.partitionBy(*keys).orderBy("__slice")
    opening = (
        closing.withColumn("__open", F.lag("__last").over(before))
        .where(F.col("__open").isNotNull())
        .select(*keys, "__slice", F.col("__open").alias(value), F.lit(0).alias("__real"))
    )
    inside = Window.partitionBy(*keys, "__slice").orderBy("__real", time, *sequence)
    return (
        rows.unionByName(opening, allowMissingColumns=True)
        .withColumn(into, F.lag(value).over(inside))
        .where(F.col("__real") == 1)
        .drop("__slice", "__real")
    )


def consecutive_failures(df: DataFrame, keys: Sequence[str], time: str, status: str, failed: str, sequence: Sequence[str] = ()) -> DataFrame:
    """Per worker, the first moment a failure directly follows another."""
    marked = with_previous(df, keys, time, status, "__prev", sequence)
    hit = marked.where((F.col(status) == failed) & (F.col("__prev") == failed))
    return hit.groupBy(*keys).agg(F.min(time).alias("cancelled_at"), F.count("*").alias("repeats"))


def shard(df: DataFrame, order: Sequence[str], offset: int, size: int) -> DataFrame:
    """Rows at ordered positions ``[offset, offset + size)``."""
    return global_ordinal(df, order).where((F.col("ordinal") >= offset) & (F.col("ordinal") < offset + size))


def describe_shard(rows: DataFrame, city: str, date: str) -> DataFrame:
    """Size, date span and the sorted cities of a shard (cities are a small domain)."""
    cities = rows.select(city).distinct().agg(F.array_join(F.sort_array(F.collect_list(city)), ",")).scalar()
    return rows.agg(
        F.min("ordinal").alias("offset_start"),
        F.max("ordinal").alias("offset_end"),
        F.count("*").alias("selected_markets"),
        F.min(date).alias("date_from"),
        F.max(date).alias("date_to"),
    ).withColumn("cities", cities)


def job_progress(log: DataFrame, time: Sequence[str]) -> DataFrame:
    """Greatest progress counters, the last error and the percentage of a job log.

    Columns: message, level, processed, total, ok, err, error.
    """
    checkpoint = F.col("message") == "backfill_forecasts checkpoint"
    failed = F.col("level").isin("ERROR", "CRITICAL") | F.contains(F.lower("message"), F.lit("error"))
    order = F.struct(*time)
    out = log.agg(
        F.coalesce(F.max(F.when(checkpoint, F.col("processed"))), F.lit(0)).alias("processed"),
        F.max_by("total", F.when(checkpoint & (F.col("total") > 0), order)).alias("total"),
        F.coalesce(F.max("ok"), F.lit(0)).alias("single_run_ok"),
        F.coalesce(F.max("err"), F.lit(0)).alias("single_run_err"),
        F.max_by(F.coalesce("error", "message"), F.when(failed, order)).alias("last_error"),
    )
    return out.withColumn(
        "pct", F.when((F.col("total") > 0) & (F.col("processed") > 0), F.round(100.0 * F.col("processed") / F.col("total"), 2)).otherwise(0.0)
    )


def collection_outcome(early_stop: Column, failed: Column, collected: Column, attempted: Column, retryable: Column) -> Column:
    """Outcome of one collection batch."""
    return (
        F.when(early_stop.isNotNull(), "rate-limit-cancelled")
        .when(failed == 0, "success")
        .when(collected > 0, "partial")
        .when((attempted > 0) & (retryable == attempted), "retry-only")
        .otherwise("interrupted")
    )


def recovery_outcome(requests: Column, hard_errors: Column, completed: Column) -> Column:
    """Outcome of one price-recovery batch."""
    return (
        F.when((requests == 0) | (hard_errors == 0), "success").when(completed > 0, "partial").otherwise("retry-only")
    )


def combo_leaderboard(rows: DataFrame, combo: str, limit: int | None = 10, policy: bool = True) -> DataFrame:
    """Counters per parameter combination in the six-key report order."""
    reason = F.col("reason")
    out = rows.groupBy(combo).agg(
        F.count("fill").alias("fills"),
        count_if(reason == "tradable").alias("tradable_rows"),
        count_if(F.col("raw_gap") > 0).alias("raw_gap_positive_count"),
        count_if(F.col("after_cost_edge") > 0).alias("after_cost_edge_positive_count"),
        count_if(reason == "fee_killed_edge").alias("fee_killed_edge"),
        count_if(reason == "raw_gap_non_positive").alias("raw_gap_non_positive"),
        count_if(reason == "policy_filtered").alias("policy_filtered"),
    )
    order = [F.desc(c) for c in ("fills", "tradable_rows", "after_cost_edge_positive_count", "raw_gap_positive_count")]
    order += [F.asc("raw_gap_non_positive"), *([F.asc("policy_filtered")] if policy else []), F.asc(combo)]
    return out if limit is None else out.orderBy(*order).limit(limit)


def fee_watchlist_model(board: DataFrame, name: str) -> DataFrame:
    """The model with most fee-killed rows, then raw gaps, then fewest empty gaps."""
    order = [F.desc("fee_killed_edge"), F.desc("raw_gap_positive_count"), F.asc("raw_gap_non_positive"), F.asc(name)]
    return board.orderBy(*order).limit(1)


def watchlist_examples(rows: DataFrame, keys: Sequence[str], arrival: Sequence[Column], sort: Sequence[str], limit: int) -> DataFrame:
    """Fee-killed rows with a break-even ask, the first of every key, sorted and cut.

    ``best_ask`` of 0 counts as missing.
    """
    from skyledger.operators.merge import keep_first

    ask = F.when(F.col("best_ask") != 0, F.col("best_ask"))
    usable = rows.where((F.col("reason") == "fee_killed_edge") & ask.isNotNull() & F.col("after_cost_edge").isNotNull())
    out = usable.withColumn(
        "watch_rule_threshold_ask", F.round(F.greatest(F.col("best_ask") + F.col("after_cost_edge"), F.lit(0.0)), 6)
    )
    return keep_first(out, keys, arrival).orderBy(*sort).limit(limit)


def dashboard_overview(opportunities: DataFrame, observations: DataFrame, queue: DataFrame, open_phase: DataFrame) -> DataFrame:
    """Head counts of the four logs in one row, from one aggregate per log."""
    parts = [
        opportunities.agg(F.struct(count_if(F.col("reason") == "tradable").alias("a"))),
        observations.agg(F.struct(count_if(F.col("queue_state") == "tradable").alias("a"))),
        queue.agg(F.struct(F.count("*").alias("a"), count_if(F.col("queue_state") == "manual_review").alias("b"))),
    ]
    out = open_phase.agg(F.count("*").alias("open_phase_count"))
    a, b, c = (p.scalar() for p in parts)
    out = out.withColumn("__a", a).withColumn("__b", b).withColumn("__c", c)
    return out.select(
        F.col("__a.a").alias("opportunity_tradable_count"),
        F.col("__b.a").alias("observation_tradable_count"),
        F.col("__c.a").alias("queue_size"),
        F.col("__c.b").alias("manual_review_count"),
        "open_phase_count",
    )


def split_count(df: DataFrame, group: Sequence[str], last_n: int = 0) -> DataFrame:
    """Number of back-test splits: groups but the first, at most ``last_n``."""
    n = df.agg(F.count_distinct(F.concat_ws("|", *group)).alias("groups"))
    splits = F.greatest(F.col("groups") - 1, F.lit(0))
    return n.withColumn("splits", F.least(splits, F.lit(last_n)) if last_n > 0 else splits)
