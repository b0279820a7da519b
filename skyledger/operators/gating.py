"""Source gating: when to lean on a fallback forecast, learned from which of two Gaussians scored better.

Everything is in Celsius. The gate sees both forecasts, each source's own daily maximum and how it differs from the
fallback, which sources are there, how far they are apart, and where and when the decision is made.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.labels import safe_token
from skyledger.functions.numeric import to_celsius, with_gaussian_crps
from skyledger.operators.features import sentinel_count
from skyledger.operators.models import gated_mixture, source_gates
from skyledger.session import short_methods, written

#: What a missing feature counts as: below every temperature, so that trees can tell it apart.
MISSING = -1000.0
DAYS = 366.0


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def categories(df: DataFrame, column: str) -> list[str]:
    """The distinct values of a category; a report's cities or horizons, so few."""
    value = F.coalesce(F.col(column).cast("string"), F.lit("unknown"))
    return sorted(r[0] for r in df.select(value.alias("v")).where(F.trim("v") != "").distinct().collect())


def source_moments(values: Sequence[Column]) -> tuple[Column, Column, Column]:
    """Mean, standard deviation and range of the non-null values among several columns, as plain arithmetic: array functions with lambdas are interpreted."""
    if not values:
        return (F.lit(None).cast("double"),) * 3
    total = lambda parts: sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    n = F.nullif(total([v.isNotNull().cast("double") for v in values]), F.lit(0.0))
    gaps = [v - F.coalesce(*values) for v in values]  # equal values have none
    off = total(gaps) / n
    spread = F.greatest(*values) - F.least(*values) if len(values) > 1 else values[0] - values[0]
    return total(values) / n, F.sqrt(total([(g - off) * (g - off) for g in gaps]) / n), spread


def gate_features(
    df: DataFrame,
    unit: str,
    sources: Mapping[str, str],
    availability: Mapping[str, str] | None = None,
    lead_hours: str | None = None,
    target_date: str | None = None,
    decision_time: str | None = None,
    one_hot: Mapping[str, Sequence[str]] | None = None,
) -> tuple[DataFrame, list[str]]:
    """Add the gate's features (names begin with ``gate_``) and return their names.

    Needs primary_mean, primary_std, fallback_mean, fallback_std in market units. ``sources`` names the daily maximum of each
    source in market units, ``availability`` the flags of those that have one (else a value counts as available),
    ``one_hot`` the known values of category columns; unknown ones get no 1. Missing values count as ``MISSING``.
    """
    u, availability, one_hot = F.col(unit), availability or {}, one_hot or {}
    number = lambda name: F.when(finite(F.col(name).cast("double")), F.col(name).cast("double"))
    pm, fm = to_celsius(number("primary_mean"), u), to_celsius(number("fallback_mean"), u)
    ps, fs = to_celsius(number("primary_std"), u, scale=True), to_celsius(number("fallback_std"), u, scale=True)
    value = {s: to_celsius(number(c), u) for s, c in sources.items()}
    flag = {s: F.coalesce(F.col(availability[s]).cast("boolean"), F.lit(False)) if s in availability else value[s].isNotNull() for s in sources}
    source_mean, source_std, source_range = source_moments(list(value.values()))
    lead = F.coalesce(number(lead_hours), F.lit(0.0)) if lead_hours else F.lit(0.0)
    day = F.coalesce(F.dayofyear(target_date), F.lit(1)) if target_date else F.lit(1)
    count = sum((f.cast("double") for f in flag.values()), F.lit(0.0))
    columns = {
        "primary_mean_c": pm, "primary_std_c": ps, "fallback_mean_c": fm, "fallback_std_c": fs,
        "mean_diff_c": pm - fm, "abs_mean_diff_c": F.abs(pm - fm), "std_diff_c": ps - fs, "abs_std_diff_c": F.abs(ps - fs),
        "lead_hours": lead, "lead_hours_sq": lead * lead,
        "day_of_year_sin": F.sin(2.0 * math.pi * day / DAYS), "day_of_year_cos": F.cos(2.0 * math.pi * day / DAYS),
        "target_month": F.coalesce(F.month(target_date), F.lit(0)) if target_date else F.lit(0),
        "decision_hour": F.coalesce(F.hour(decision_time), F.lit(0)) if decision_time else F.lit(0),
        "sentinel_daily_max_count": sentinel_count(list(sources.values()), u) if sources else F.lit(0),
        "source_mean_c": source_mean, "source_std_c": source_std, "source_range_c": source_range,
        "available_source_count": count, "available_source_fraction": count / max(len(sources), 1),
    }
    for s in sources:
        columns |= {f"{s}_daily_max_c": value[s], f"{s}_delta_vs_fallback_c": value[s] - fm, f"avail__{s}": flag[s]}
    # values become column names, so they are made safe as they are for the market's own columns
    spark = df.sparkSession
    for column, known in one_hot.items():
        here = F.coalesce(F.col(column).cast("string"), F.lit("unknown"))
        rows = spark.createDataFrame([(v,) for v in known], "v string").select("v", safe_token(F.col("v")).alias("t")).collect() if known else []
        columns |= {f"{column}__{t}_{i}": here == v for i, (v, t) in enumerate(map(tuple, rows))}
    out = df.withColumns({f"gate_{n}": F.coalesce(c.cast("double"), F.lit(MISSING)) for n, c in columns.items()})
    return out, [f"gate_{n}" for n in columns]


def source_gated(
    df: DataFrame,
    y: str,
    unit: str,
    sources: Mapping[str, str],
    group: Sequence[str] = (),
    margin: float = 0.0,
    low: float = 0.0,
    high: float = 1.0,
    min_std: float = 0.1,
    weight_mode: str = "uniform",
    n_splits: int = 4,
    max_iter: int = 20,
    **about,
) -> DataFrame:
    """Blend a primary and a fallback Gaussian by a learned gate; adds fallback_weight, in_sample, pred_mean, pred_std and both CRPS (Celsius).

    The gate learns from rows with a truth and both forecasts. With ``group`` (in time order) each validation fold is
    scored by a gate of the groups before it; other rows, and all without ``group``, by the gate of all rows, which ``in_sample`` says.
    ``about``: see ``gate_features``.
    """
    from skyledger.operators.folds import validation_folds

    u = F.col(unit)
    number = lambda name: F.when(finite(F.col(name).cast("double")), F.col(name).cast("double"))
    # the groups' order, the categories and the features read the rows: one copy instead of three runs of what makes them
    df = written(df, "gate-rows")
    folded = validation_folds(df, group, n_splits) if group else df.withColumns({"fold": F.lit(None).cast("bigint"), "ordinal": F.lit(0)})
    known = [number(c).isNotNull() for c in (y, "primary_mean", "primary_std", "fallback_mean", "fallback_std")]
    rows = folded.withColumn("__valid", known[0] & known[1] & known[2] & known[3] & known[4])
    rows = rows.withColumns(
        {
            "__y": to_celsius(number(y), u),
            **{f"__{s}m": to_celsius(number(f"{s}_mean"), u) for s in ("primary", "fallback")},
            **{f"__{s}s": F.greatest(to_celsius(number(f"{s}_std"), u, scale=True), F.lit(min_std)) for s in ("primary", "fallback")},
        }
    )
    for s in ("primary", "fallback"):
        rows = with_gaussian_crps(rows, f"__{s}m", f"__{s}s", "__y", f"{s}_crps")
        rows = rows.withColumn(f"{s}_crps", F.when(F.col("__valid"), F.col(f"{s}_crps")))
    one_hot = {c: categories(rows.where("__valid"), c) for c in about.pop("one_hot", ())}
    ready, names = gate_features(rows, unit, sources, one_hot=one_hot, **about)
    with short_methods(df.sparkSession):
        ready = written(ready.drop(*[c for c in rows.columns if c.startswith("__") and c not in df.columns]), "gate")

    out = source_gates(ready, names, "fold", "ordinal", margin, max_iter, weight_mode=weight_mode).withColumn("in_sample", F.col("fold").isNull())
    out = out.withColumn("fallback_weight", F.least(F.greatest("fallback_weight", F.lit(low)), F.lit(high)))
    return gated_mixture(out, "fallback_weight", unit, min_std).drop(*names, "fold", "ordinal")
