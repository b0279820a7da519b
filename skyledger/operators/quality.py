"""Checks over tables: floors, duplicates, order, names, contamination, status ladders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.operators.quantiles import null_safe_join
from skyledger.operators.reports import count_if

# Words that give a feature away as an outcome.
LEAKY_WORDS = ("realized", "winning", "settlement", "truth")
FIXTURE_VALUES = ("fixture", "demo_fixture")


def full_duplicates(df: DataFrame) -> DataFrame:
    """Rows beyond the first of every identical row."""
    per = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    return per.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))


def null_cells(df: DataFrame) -> DataFrame:
    total = reduce(lambda a, b: a + b, [count_if(F.col(c).isNull()) for c in df.columns])
    return df.agg(total.alias("null_cells"))


def numeric_features(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def dataset_checks(
    df: DataFrame,
    market: str,
    horizon: str,
    issued: str,
    decided: str,
    tier: str,
    features: Sequence[str],
    expected_horizons: int = 3,
) -> DataFrame:
    """Check table (check, status, value) of a training set.

    Cell and row facts come from one aggregate, the horizon count from one more;
    a failed check is ``fail`` or, for advice, ``warn``.
    """
    order_bad = F.col(issued).isNull() | F.col(decided).isNull() | (F.col(issued) > F.col(decided))
    nulls = reduce(lambda a, b: a + b, [count_if(F.col(c).isNull()) for c in df.columns])
    constant = reduce(
        lambda a, b: a + b,
        [F.when(F.coalesce(F.min(c) != F.max(c), F.lit(False)), 0).otherwise(1) for c in features],
        F.lit(0),
    )
    leaky = sum(any(w in c.lower() for w in LEAKY_WORDS) for c in features)
    facts = df.agg(
        F.count("*").alias("non_empty"),
        nulls.alias("null_cells"),
        count_if(order_bad).alias("issue_time_not_after_decision_time"),
        constant.cast("bigint").alias("no_constant_numeric_features"),
        count_if(F.col(tier).isNull()).alias("truth_tier_explicit"),
        count_if(F.col(tier) == "research_public").alias("exact_truth_coverage"),
    )
    per_market = df.groupBy(market).agg(F.count_distinct(horizon).alias("n"))
    bad_markets = per_market.agg(count_if(F.col("n") != expected_horizons)).scalar()
    duplicates = full_duplicates(df).scalar()
    facts = (
        facts.withColumn("three_horizons_per_market", bad_markets)
        .withColumn("duplicate_rows", duplicates)
        .withColumn("no_obvious_leaky_feature_names", F.lit(leaky).cast("bigint"))
    )
    severity = {
        "non_empty": "fail",
        "duplicate_rows": "fail",
        "null_cells": "warn",
        "three_horizons_per_market": "warn",
        "issue_time_not_after_decision_time": "fail",
        "no_obvious_leaky_feature_names": "fail",
        "no_constant_numeric_features": "warn",
        "truth_tier_explicit": "warn",
        "exact_truth_coverage": "warn",
    }
    rows = []
    for name, level in severity.items():
        good = F.col(name) > 0 if name == "non_empty" else F.col(name) == 0
        rows.append(
            F.struct(
                F.lit(name).alias("check"),
                F.when(good, "pass").otherwise(level).alias("status"),
                F.col(name).cast("bigint").alias("value"),
            )
        )
    return facts.select(F.inline(F.array(*rows)))


def quality_score(checks: DataFrame, exact_ratio: Column, non_ready: Column) -> DataFrame:
    """Ten points less 1 per failed and 0.25 per advised check, less penalties for a
    small exact share and for markets that are not ready."""
    tier = F.when(exact_ratio < 0.25, 1.25).when(exact_ratio < 0.60, 0.75).otherwise(0.0)
    unready = F.least(F.lit(0.5), non_ready / 100.0)
    fails, warns = count_if(F.col("status") == "fail"), count_if(F.col("status") == "warn")
    out = checks.agg(fails.alias("fails"), warns.alias("warns"))
    score = F.greatest(F.round(10.0 - F.col("fails") - 0.25 * F.col("warns") - tier - unready, 2), F.lit(0.0))
    return out.withColumn("score_10pt", score).withColumn(
        "grade", F.when(F.col("score_10pt") >= 7.0, "research-grade").otherwise("needs-repair")
    )


def contamination(tables: Mapping[str, DataFrame], markets: str = "market_id", fixture_columns: Sequence[str] = ("endpoint_kind", "status", "availability_status", "source", "forecast_source_kind")) -> DataFrame:
    """Synthetic and fixture rows per table; only findings are listed."""
    parts = []
    for name, df in tables.items():
        found = []
        if markets in df.columns:
            found.append((f"{name}.synthetic_market_id", F.col(markets).startswith("synthetic_")))
        found += [(f"{name}.{c}_fixture", F.col(c).isin(*FIXTURE_VALUES)) for c in fixture_columns if c in df.columns]
        if not found:
            continue
        counts = df.agg(*[count_if(cond).alias(f"c{i}") for i, (_, cond) in enumerate(found)])
        entries = [F.struct(F.lit(label).alias("finding"), F.col(f"c{i}").alias("rows")) for i, (label, _) in enumerate(found)]
        parts.append(counts.select(F.inline(F.array(*entries))))
    return reduce(DataFrame.unionByName, parts).where(F.col("rows") > 0)


def trust_report(findings: DataFrame, profile: str, inventory_profile: str | None, required: str = "real_market") -> DataFrame:
    """Preflight issues: wrong profile, unlike inventory, contaminated tables."""
    spark = findings.sparkSession
    issues = []
    if profile != required:
        issues.append(("dataset_profile", profile))
    if inventory_profile is not None and inventory_profile != profile:
        issues.append(("workspace_inventory_match", inventory_profile))
    if inventory_profile == "synthetic":
        issues.append(("synthetic_inventory_forbidden", inventory_profile))
    rules = spark.createDataFrame(issues, "check string, detail string")
    dirty = findings.select(
        F.lit("warehouse_contamination").alias("check"), F.concat_ws("=", "finding", F.col("rows").cast("string")).alias("detail")
    )
    return rules.unionByName(dirty)


def mark_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], into: str) -> DataFrame:
    """Whether a row is the first of its key. The first arrival is an aggregate
    joined back, so no task has to hold a whole key as a window would."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__first"))
    return null_safe_join(df, first, keys).withColumn(into, F.struct(*order) == F.col("__first")).drop("__first")


def inventory_issues(df: DataFrame, market: str, order: Sequence[str], supported: Sequence[str]) -> DataFrame:
    """Issues of a curated inventory, one row each.

    Columns used: parse_error, city, spec_hash, reparsed_hash. A repeated id stops
    there; a parse error or missing spec hides the later checks.
    """
    seen = mark_first(df, [market], order, "__one")
    repeated = ~F.col("__one") & (F.col(market) != "")
    parsed = F.col("parse_error").isNull()
    spec = parsed & F.col("city").isNotNull()
    checks = {
        "duplicate_market_id": repeated,
        "example_market_id": ~repeated & F.col(market).startswith("example-"),
        "parse_error": ~repeated & ~parsed,
        "missing_spec": ~repeated & parsed & F.col("city").isNull(),
        "unsupported_city": ~repeated & spec & ~F.lower("city").isin(*[c.lower() for c in supported]),
        "reparse_failed": ~repeated & spec & F.col("reparsed_hash").isNull(),
        "spec_mismatch": ~repeated & spec & (F.col("reparsed_hash") != F.col("spec_hash")),
    }
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in checks.items()]))
    return seen.withColumn("reason", F.explode(reasons)).drop("__one")


def collection_status(df: DataFrame, url: str, market: str, order: Sequence[str], supported: Sequence[str], cutoff: Column) -> DataFrame:
    """Status and detail of every fetched event, the first failing check deciding.

    Columns used: fetch_error, has_html, parse_error, city, target_date,
    components, closed_components, truth_status, truth_detail, known (the market
    was collected before). A market collected more than once in a run is ambiguous,
    so all its entries become duplicates.
    """
    from skyledger.functions.labels import unsupported_rule

    rows = mark_first(df, [url], order, "__u")
    bad_rule = unsupported_rule(F.col("parse_error"))

    def verdict(status, detail) -> Column:
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(as_col(status).alias("status"), as_col(detail).cast("string").alias("detail"))

    early = (
        F.when(~F.col("__u"), verdict("duplicate", "duplicate_url"))
        .when(F.col("fetch_error").isNotNull(), verdict("parse_failed", F.col("fetch_error")))
        .when(~F.col("has_html"), verdict("parse_failed", "missing_event_html"))
        .when(F.col("parse_error").isNotNull(), verdict(F.when(bad_rule, "unsupported_rule").otherwise("parse_failed"), F.col("parse_error")))
        .when(F.col("city").isNull(), verdict("parse_failed", "missing_spec"))
        .when(~F.lower("city").isin(*[c.lower() for c in supported]), verdict("unsupported_rule", "unsupported_city"))
        .when(F.col("target_date") >= cutoff, verdict("not_historical", "not_historical"))
        .when(F.col("components") <= 0, verdict("parse_failed", "missing_component_markets"))
        .when(F.col("closed_components") < F.col("components"), verdict("not_closed", "not_closed"))
    )
    late = (
        F.when(F.col("known"), verdict("duplicate", "duplicate_market_id"))
        .when(F.col("truth_status") != "ready", verdict(F.col("truth_status"), F.col("truth_detail")))
        .otherwise(verdict("collected", None))
    )
    rows = rows.withColumn("__v", F.coalesce(early, late))
    collected = F.col("__v.status") == "collected"
    twice = rows.where(collected).groupBy(market).agg(F.count("*").alias("__n")).where(F.col("__n") > 1)
    rows = null_safe_join(rows, twice, [market])
    again = collected & (F.col("__n") > 1)
    return rows.select(
        *df.columns,
        F.when(again, "duplicate").otherwise(F.col("__v.status")).alias("status"),
        F.when(again, "duplicate_market_id").otherwise(F.col("__v.detail")).alias("detail"),
    )
