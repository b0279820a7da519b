"""Forecast aggregates, source choice, training rows and design columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import numeric as N
from skyledger.operators.quantiles import grouped_quantiles

HISTORICAL_KEY = "__historical__"
# Daily features of a forecast, and which of them are temperatures
# or temperature differences when a market settles in Fahrenheit.
DAILY_FEATURES = (
    "model_daily_max",
    "model_daily_mean",
    "model_daily_min",
    "diurnal_amplitude",
    "midday_temp",
    "cloud_cover_mean",
    "wind_speed_mean",
    "humidity_mean",
    "dew_point_mean",
    "num_hours",
)
# The daily mean, minimum and maximum keep the suffix rules of the stored columns.
ABSOLUTE_FEATURES = ("model_daily_max", "model_daily_mean", "model_daily_min", "midday_temp", "dew_point_mean")
DIFFERENCE_FEATURES = ("diurnal_amplitude",)
ZERO = 1e-9


def daily_features(hourly: DataFrame, keys: Sequence[str] = ("market_id", "model_name", "endpoint_kind")) -> DataFrame:
    """Target-day aggregates of hourly rows per market, model, endpoint and horizon.

    One hash aggregate with conditional inputs; the issue time is the latest of
    all rows, not only those of the target day.
    """
    on_day = F.col("local_date") == F.col("target_local_date")

    def day(column: str) -> Column:
        return F.when(on_day, F.col(column))

    midday = F.when(on_day & F.col("hour").between(11, 15), F.col("temperature_2m"))
    temp = day("temperature_2m")
    return hourly.groupBy(*keys, F.coalesce("decision_horizon", F.lit(HISTORICAL_KEY)).alias("dh_key")).agg(
        F.max(temp).alias("model_daily_max"),
        F.avg(temp).alias("model_daily_mean"),
        F.min(temp).alias("model_daily_min"),
        (F.max(temp) - F.min(temp)).alias("diurnal_amplitude"),
        F.avg(midday).alias("midday_temp"),
        F.avg(day("cloud_cover")).alias("cloud_cover_mean"),
        F.avg(day("wind_speed_10m")).alias("wind_speed_mean"),
        F.avg(day("relative_humidity_2m")).alias("humidity_mean"),
        F.avg(day("dew_point_2m")).alias("dew_point_mean"),
        F.count(F.when(on_day, F.lit(1))).alias("num_hours"),
        F.max("issue_time_utc").alias("latest_issue_time_utc"),
    )


def with_midday_fallback(features: DataFrame) -> DataFrame:
    return features.withColumn("midday_temp", F.coalesce("midday_temp", "model_daily_mean"))


def features_valid() -> Column:
    """Usable aggregate: target-day hours, no missing temperature, not all zero."""
    temps = [F.col(c) for c in ("model_daily_max", "model_daily_mean", "model_daily_min")]
    present = reduce(lambda a, b: a & b, [t.isNotNull() for t in temps])
    flat = reduce(lambda a, b: a & b, [F.abs(t) <= ZERO for t in temps]) & (
        F.abs(F.coalesce(F.col("diurnal_amplitude"), F.lit(0.0))) <= ZERO
    )
    return F.coalesce((F.col("num_hours") > 0) & present & ~flat, F.lit(False))


def temperatures_missing() -> Column:
    """Target-day hours exist, but none carries a temperature."""
    temps = [F.col(c) for c in ("model_daily_max", "model_daily_mean", "model_daily_min")]
    return (F.col("num_hours") > 0) & reduce(lambda a, b: a & b, [t.isNull() for t in temps])


def select_sources(features: DataFrame, decisions: DataFrame, keys: Sequence[str] = ("market_id",)) -> DataFrame:
    """Best admissible forecast per decision and model.

    ``decisions`` has the keys, decision_horizon and issue_time_utc. Order of
    preference: the horizon's single run, the fixture, the historical forecast.
    A historical forecast must be issued by the decision's issue time; one
    without an issue time counts only where a single run exists without any
    temperature.
    """
    keys = list(keys)
    by = [*keys, "model_name"]
    kept = F.struct(*DAILY_FEATURES, "latest_issue_time_utc")
    flagged = features.withColumn("__valid", features_valid()).withColumn("__missing", temperatures_missing())

    def of(kind: str, dh: Column) -> Column:
        return (F.col("endpoint_kind") == kind) & (F.col("dh_key") == dh)

    # Long form: every candidate of a model joins the decisions of its market once.
    d = decisions.select(*keys, "decision_horizon", F.col("issue_time_utc").alias("__by"))
    candidates = flagged.join(d, keys).where(
        of("single_run", F.col("decision_horizon"))
        | of("fixture", F.lit(HISTORICAL_KEY))
        | of("historical_forecast", F.lit(HISTORICAL_KEY))
    )

    def pick(kind: str, condition: Column) -> Column:
        return F.max(F.when((F.col("endpoint_kind") == kind) & condition, kept))

    issue = F.col("latest_issue_time_utc")
    per = candidates.groupBy(*by, "decision_horizon").agg(
        pick("single_run", F.col("__valid")).alias("__s"),
        pick("fixture", F.col("__valid")).alias("__f"),
        pick("historical_forecast", F.col("__valid") & (issue <= F.col("__by"))).alias("__h"),
        pick("historical_forecast", F.col("__valid") & issue.isNull()).alias("__u"),
        F.bool_or((F.col("endpoint_kind") == "single_run") & F.col("__missing")).alias("__empty_run"),
    )
    undated = F.when(F.coalesce("__empty_run", F.lit(False)), F.col("__u"))
    chosen = F.coalesce("__s", "__f", "__h", undated)
    kind = (
        F.when(F.col("__s").isNotNull(), "single_run")
        .when(F.col("__f").isNotNull(), "fixture")
        .otherwise("historical_forecast")
    )
    out = per.withColumn("__c", chosen).where(F.col("__c").isNotNull())
    return out.select(*by, "decision_horizon", kind.alias("endpoint_kind"), "__c.*")


def hourly_of_selected(hourly: DataFrame, selected: DataFrame, keys: Sequence[str] = ("market_id",)) -> DataFrame:
    """Hourly rows of the chosen source per decision and model: a single run by its
    horizon, any other source by its rows without one."""
    s = selected.select(*keys, "model_name", "endpoint_kind", F.col("decision_horizon").alias("for_horizon"))
    joined = hourly.join(s, [*keys, "model_name", "endpoint_kind"])
    return joined.where(
        F.when(F.col("endpoint_kind") == "single_run", F.col("decision_horizon") == F.col("for_horizon")).otherwise(
            F.col("decision_horizon").isNull()
        )
    )


def tiered_rows(hourly: DataFrame, keys: Sequence[str], horizon: str) -> DataFrame:
    """Earlier, simpler choice per market: single run with a non-zero temperature,
    else historical rows, else rows without horizon, else all. The flags are one
    aggregate per market, joined back, so a large market is not windowed."""
    single = (F.col("endpoint_kind") == "single_run") & F.coalesce(F.col("decision_horizon") == horizon, F.lit(False))
    historical = F.col("endpoint_kind") == "historical_forecast"
    generic = F.col("decision_horizon").isNull()
    temp = F.col("temperature_2m")
    nonzero = temp.isNull() | (temp != 0)
    tier = (
        F.when(F.bool_or(single & nonzero), 1).when(F.bool_or(historical), 2).when(F.bool_or(generic), 3).otherwise(4)
    )
    tiers = hourly.groupBy(*keys).agg(tier.alias("__tier"))
    keep = (
        F.when(F.col("__tier") == 1, single)
        .when(F.col("__tier") == 2, historical)
        .when(F.col("__tier") == 3, generic)
        .otherwise(F.lit(True))
    )
    return hourly.join(tiers, list(keys)).where(keep).drop("__tier")


def convert_features(df: DataFrame, unit: str = "unit") -> DataFrame:
    """Celsius features in the market's unit: temperatures shift and scale, the
    amplitude only scales, the rest stays."""
    u = F.col(unit)
    changes = {c: N.from_celsius(F.col(c), u) for c in ABSOLUTE_FEATURES if c in df.columns}
    changes.update({c: N.from_celsius(F.col(c), u, scale=True) for c in DIFFERENCE_FEATURES if c in df.columns})
    return df.withColumns(changes)


def wide_features(selected: DataFrame, keys: Sequence[str], models: Sequence[str], features: Sequence[str] = DAILY_FEATURES) -> DataFrame:
    """One row per decision with ``{model}_{feature}`` columns for a given model list."""
    present = F.col("model_name")
    columns = [
        F.max(F.when(present == m, F.col(f))).alias(f"{m}_{f}") for m in models for f in features
    ]
    wide = selected.where(present.isin(*models)).groupBy(*keys).agg(
        *columns,
        F.max("latest_issue_time_utc").alias("latest_issue_time_utc"),
        F.bool_or(F.col("endpoint_kind") == "single_run").alias("__single"),
        *[F.bool_or(present == m).alias(f"__has_{m}") for m in models],
    )
    first = F.coalesce(*[F.col(f"{m}_model_daily_max") for m in models])
    used = F.array_compact(F.array(*[F.when(F.col(f"__has_{m}"), m) for m in models]))
    available = F.to_json(F.create_map(*[x for m in sorted(models) for x in (F.lit(m), F.col(f"__has_{m}"))]))
    return (
        wide.withColumn("model_daily_max", first)
        .withColumn("forecast_source_kind", F.when(F.col("__single"), "single_run").otherwise("historical_forecast"))
        .withColumn("selected_models", used)
        .withColumn("feature_availability_json", available)
        .drop("__single", *[f"__has_{m}" for m in models])
    )


def neighbor_features(df: DataFrame, mean_of: str, fallback: str, pair: tuple[str, str]) -> DataFrame:
    """Neighbour mean with its fallback chain; the spread only where both members exist."""
    return df.withColumn("neighbor_mean_temp", F.coalesce(F.col(mean_of), F.col(fallback), F.lit(0.0))).withColumn(
        "neighbor_spread", F.abs(F.col(pair[0]) - F.col(pair[1]))
    )


def training_rows(
    markets: DataFrame,
    truth: DataFrame,
    hourly: DataFrame,
    models: Sequence[str],
    horizons: Sequence[str],
) -> DataFrame:
    """Training rows per market and horizon, assembled as one plan.

    ``markets``: market_id, city, timezone, unit, target_date, bins.
    ``truth``: market_id, daily_max. Markets without truth and horizons without
    any admissible forecast give no row.
    """
    from skyledger.functions.clock import decision_point
    from skyledger.operators.bins import winning_label

    decisions = (
        markets.join(truth, "market_id")
        .withColumn("decision_horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
        .withColumn("__at", decision_point(F.col("target_date"), F.col("decision_horizon"), F.col("timezone")))
        .select("*", "__at.*")
        .drop("__at")
    )
    features = with_midday_fallback(daily_features(hourly))
    selected = select_sources(features, decisions)
    units = markets.select("market_id", "unit")
    wide = wide_features(convert_features(selected.join(units, "market_id")), ["market_id", "decision_horizon"], models)
    rows = decisions.withColumnRenamed("issue_time_utc", "__issue").join(wide, ["market_id", "decision_horizon"])
    rows = rows.withColumn("issue_time_utc", F.coalesce("latest_issue_time_utc", "__issue")).drop("__issue", "latest_issue_time_utc")
    return rows.withColumn("winning_outcome", winning_label(F.col("bins"), F.col("daily_max"))).withColumn(
        "group_id", F.concat_ws("|", "market_id", F.date_format("target_date", "yyyy-MM-dd"))
    )


def sequence_rows(hourly: DataFrame, keys: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """Ordered arrays of hourly values per decision and model, with length and mask.

    A group holds the hours of one forecast, which its horizon bounds.
    """
    entry = F.struct(time, *values)
    packed = hourly.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("__h"))
    return packed.select(
        *keys,
        F.size("__h").alias("sequence_length"),
        F.col(f"__h.{time}").alias("time_index"),
        *[F.col(f"__h.{v}").alias(v) for v in values],
        F.array_repeat(F.lit(1), F.size("__h")).alias("valid_mask"),
    )


def station_day_rows(hourly: DataFrame, keys: Sequence[str], source: str, value: str, time: str, extras: Sequence[str] = ()) -> DataFrame:
    """One row per station, day and model: forecast statistics beside the observed
    maximum, with the hourly forecast as JSON (24 values at most)."""
    f = F.when(F.col(source) == "forecast", F.col(value))
    o = F.when(F.col(source) == "observation", F.col(value))
    hours = F.sort_array(F.collect_list(F.when(F.col(source) == "forecast", F.struct(time, value))))
    return hourly.groupBy(*keys).agg(
        F.min(f).alias("forecast_min"),
        F.avg(f).alias("forecast_mean"),
        F.max(f).alias("forecast_max"),
        F.max(o).alias("observed_max"),
        *[F.avg(F.when(F.col(source) == "forecast", F.col(e))).alias(f"{e}_mean") for e in extras],
        F.to_json(F.transform(hours, lambda h: h[value])).alias("hourly_json"),
    )


def daily_max(samples: Column) -> Column:
    """Daily maximum of every sampled trajectory (array of arrays)."""
    return F.transform(samples, lambda s: F.array_max(s))


def ensemble_statistics(members: DataFrame, keys: Sequence[str], member: str, value: str) -> DataFrame:
    """Mean, population deviation and range of the members' maxima."""
    peaks = members.groupBy(*keys, member).agg(F.max(value).alias("__peak"))
    return peaks.groupBy(*keys).agg(
        F.count("*").alias("members"),
        F.avg("__peak").alias("ensemble_mean"),
        F.stddev_pop("__peak").alias("ensemble_std"),
        (F.max("__peak") - F.min("__peak")).alias("ensemble_range"),
    )


def lagged_ensemble(runs: Column) -> Column:
    """Member trajectories (array of arrays) cut to the shortest."""
    n = F.array_min(F.transform(runs, lambda r: F.size(r)))
    return F.transform(runs, lambda r: F.slice(r, F.lit(1), n))


# --- climate ---------------------------------------------------------------------


def climate_normals(df: DataFrame, city: str, date: str, actual: str, forecast: str | None = None, min_rows: int = 5) -> DataFrame:
    """Mean, floored deviation and forecast bias per city and month with enough rows."""
    y = F.col(actual)
    bias = (F.avg(y - F.col(forecast)) if forecast else F.lit(None).cast("double")).alias("forecast_bias")
    out = df.where(y.isNotNull()).groupBy(city, F.month(date).alias("month")).agg(
        F.count("*").alias("n"),
        F.avg(y).alias("clim_mean"),
        F.greatest(F.stddev_samp(y), F.lit(0.5)).alias("clim_std"),
        bias,
    )
    return out.where(F.col("n") >= min_rows)


def climate_features(df: DataFrame, normals: DataFrame, city: str, date: str, forecast: str) -> DataFrame:
    """Anomaly, standardized anomaly and bias correction; zero where no normal exists."""
    n = normals.select(F.col(city).alias("__c"), F.col("month").alias("__m"), "clim_mean", "clim_std", "forecast_bias")
    j = df.withColumn("__month", F.coalesce(F.month(date), F.lit(1)))
    j = j.join(n, (F.col(city) == F.col("__c")) & (F.col("__month") == F.col("__m")), "left")
    f = F.col(forecast)
    delta = F.coalesce(f - F.col("clim_mean"), F.lit(0.0))
    bias = F.coalesce(F.col("forecast_bias"), F.lit(0.0))
    return j.withColumns(
        {
            "clim_delta": delta,
            "clim_zscore": F.coalesce(delta / F.col("clim_std"), F.lit(0.0)),
            "forecast_bias": bias,
            "bias_corrected": f + bias,
        }
    ).drop("__month", "__c", "__m", "clim_mean", "clim_std")


def climatology(df: DataFrame, station: str, date: str, actual: str, default_std: float = 3.0) -> DataFrame:
    """Mean and deviation per station and calendar day (null stations dropped)."""
    return df.where(F.col(station).isNotNull()).groupBy(station, F.month(date).alias("month"), F.dayofmonth(date).alias("day")).agg(
        F.avg(actual).alias("mean"),
        F.greatest(F.coalesce(F.stddev_samp(actual), F.lit(default_std)), F.lit(0.5)).alias("std"),
    )


def climatology_predict(df: DataFrame, table: DataFrame, station: str, date: str, default_mean: Column, default_std: Column) -> DataFrame:
    """Station-day climatology with the overall mean and deviation as fallback."""
    t = table.select(F.col(station).alias("__s"), "month", "day", F.col("mean").alias("__mean"), F.col("std").alias("__std"))
    j = df.withColumn("__m", F.month(date)).withColumn("__d", F.dayofmonth(date))
    on = (F.col(station) == F.col("__s")) & (F.col("__m") == F.col("month")) & (F.col("__d") == F.col("day"))
    out = j.join(t, on, "left")
    return out.withColumn("mean", F.coalesce("__mean", default_mean)).withColumn("std", F.coalesce("__std", default_std)).drop(
        "__s", "__m", "__d", "month", "day", "__mean", "__std"
    )


# --- design columns ----------------------------------------------------------------


def feature_medians(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exact median of every feature in one job: (feature, median), 0 if all null."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    long = df.select(F.inline(pairs))
    found = grouped_quantiles(long, ["feature"], "value", {"median": 0.5})
    names = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.join(found, "feature", "left").fillna(0.0, subset=["median"])


def select_features(df: DataFrame, exclude: Sequence[str] = (), prefixes: Sequence[str] = (), suffixes: Sequence[str] = ()) -> list[str]:
    """Numeric columns with more than one distinct value (null counts as a value).

    Only the least, the greatest and the null count are needed, so one cheap
    aggregate decides for all columns.
    """
    from pyspark.sql import types as T

    names = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType)
        and f.name not in exclude
        and not f.name.startswith(tuple(prefixes))
        and not f.name.endswith(tuple(suffixes))
    ]
    if not names:
        return []
    facts = df.agg(
        *[
            F.coalesce(
                (F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count("*"))), F.lit(False)
            ).alias(c)
            for c in names
        ]
    ).first()
    return [c for c in names if facts[c]]


def availability(df: DataFrame, features: Sequence[str], json_column: str | None = None) -> DataFrame:
    """Filled features with ``miss__`` and ``avail__`` indicators and their fraction.

    Availability comes from a JSON map where it names the feature, else from the
    value being there.
    """
    parsed = F.from_json(json_column, "map<string,boolean>") if json_column else None

    def avail(f: str) -> Column:
        here = F.col(f).isNotNull()
        said = F.try_element_at(parsed, F.lit(f)) if parsed is not None else F.lit(None).cast("boolean")
        return F.coalesce(said, here).cast("double")

    out = df.withColumns({f"miss__{f}": F.col(f).isNull().cast("double") for f in features})
    out = out.withColumns({f"avail__{f}": avail(f) for f in features})
    return out.withColumn(
        "available_feature_fraction", reduce(lambda a, b: a + b, [F.col(f"avail__{f}") for f in features]) / len(features)
    )


def impute(df: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    return df.fillna({k: float(v) for k, v in medians.items() if k in df.columns})


def one_hot(df: DataFrame, column: str, categories: Sequence[str], prefix: str) -> DataFrame:
    """Explicit 0/1 columns for a fitted category list."""
    import re

    def token(c: str) -> str:
        return re.sub(r"[^a-z0-9]+", "_", c.strip().lower()).strip("_")

    return df.withColumns(
        {f"{prefix}__{token(c)}": F.coalesce(F.col(column) == c, F.lit(False)).cast("double") for c in categories}
    )


def city_month_dummies(df: DataFrame, city: str, date: str, cities: Sequence[str]) -> DataFrame:
    """0/1 columns for every fitted city and month."""
    month = F.coalesce(F.month(date), F.lit(1))
    return df.withColumns(
        {
            f"cm__{c.lower()}__m{m:02d}": F.coalesce((F.col(city) == c) & (month == m), F.lit(False)).cast("double")
            for c in cities
            for m in range(1, 13)
        }
    )


def spread_features(df: DataFrame, columns: Sequence[str], prefix: str = "nwp") -> DataFrame:
    """Range, population deviation and mean across model columns, nulls skipped."""
    values = N.present([F.col(c).cast("double") for c in columns])
    return df.withColumn("__v", values).withColumns(
        {
            f"{prefix}_spread": F.coalesce(N.array_range(F.col("__v")), F.lit(0.0)),
            f"{prefix}_std": F.coalesce(N.array_std(F.col("__v")), F.lit(0.0)),
            f"{prefix}_ens_mean": F.coalesce(N.array_mean(F.col("__v")), F.lit(0.0)),
        }
    ).drop("__v")


def pair_differences(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    return df.withColumns({n: F.coalesce(F.col(a) - F.col(b), F.lit(0.0)) for n, (a, b) in pairs.items()})


def source_range_celsius(columns: Sequence[str], unit: Column) -> Column:
    """Range across the available sources in Celsius, 0 without any."""
    values = N.present([N.to_celsius(F.col(c), unit) for c in columns])
    return F.coalesce(N.array_range(values), F.lit(0.0))


def sentinel_count(columns: Sequence[str], unit: Column, tolerance: float = 0.2) -> Column:
    """Columns that look like a stored 0 degrees Celsius.

    The tolerance grows by 1e-5 of the reference value, so it is 0.20032 at 32 F.
    """
    zero = F.when(unit == "F", 32.0).otherwise(0.0)
    limit = F.lit(tolerance) + F.lit(1e-5) * F.abs(zero)
    return reduce(lambda a, b: a + b, [F.when(F.abs(F.col(c) - zero) <= limit, 1).otherwise(0) for c in columns])


def weather_interactions(df: DataFrame, p: str = "") -> DataFrame:
    """Products that encode known couplings between the weather variables."""
    c = lambda name: F.col(f"{p}{name}")
    return df.withColumns(
        {
            "wx_cloud_diurnal": c("cloud_cover_mean") * c("diurnal_amplitude"),
            "wx_dew_depression": c("model_daily_max") - c("dew_point_mean"),
            "wx_heat_index_proxy": c("model_daily_max") * c("humidity_mean") / 100.0,
            "wx_wind_diurnal": c("wind_speed_mean") * c("diurnal_amplitude"),
        }
    )


def align(df: DataFrame, columns: Sequence[str], fill: float | None = 0.0, keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the fitted columns: absent ones filled, extras dropped."""
    absent = F.lit(fill).cast("double")
    return df.select(*keep, *[F.col(c) if c in df.columns else absent.alias(c) for c in columns])


def city_latitude(df: DataFrame, stations: DataFrame, city: str) -> DataFrame:
    """Latitude over 90 per city, 0 for an unknown one."""
    s = stations.groupBy(F.col("city").alias("__c")).agg(F.first("lat").alias("__lat"))
    return df.join(s, df[city] == s["__c"], "left").withColumn(
        "city_latitude", F.coalesce(F.col("__lat") / 90.0, F.lit(0.0))
    ).drop("__c", "__lat")


def enrich_station(df: DataFrame, stations: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Station columns by station id, else by city name or alias (case-folded)."""
    by_id = stations.select(F.lower("station_id").alias("__id"), *[F.col(c).alias(f"__i_{c}") for c in columns])
    names = stations.select(
        F.explode(F.array_union(F.array(F.lower("city")), F.transform("aliases", lambda a: F.lower(a)))).alias("__name"),
        *[F.col(c).alias(f"__n_{c}") for c in columns],
    ).dropDuplicates(["__name"])
    out = df.join(by_id, F.lower(df["station_id"]) == by_id["__id"], "left")
    out = out.join(names, F.lower(df["city"]) == names["__name"], "left")
    return out.select(
        *[c for c in df.columns if c not in columns], *[F.coalesce(f"__i_{c}", f"__n_{c}").alias(c) for c in columns]
    )
