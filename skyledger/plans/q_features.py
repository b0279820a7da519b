"""Forecast aggregates, source choice, training rows and design columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import numeric as N
from skyledger.operators import bins as B
from skyledger.operators import features as X
from skyledger.plans import roles
from skyledger.plans.registry import query
from skyledger.plans.roles import with_roles
from skyledger.sources.tables import table


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


DAY = "FILTER (local_date = target_local_date)"
A1_SQL = f"""a1 AS (SELECT market_id, model_name, endpoint_kind, coalesce(decision_horizon, '__historical__') AS dh_key, max(temperature_2m) {DAY} AS model_daily_max,
    avg(temperature_2m) {DAY} AS model_daily_mean, min(temperature_2m) {DAY} AS model_daily_min, max(temperature_2m) {DAY} - min(temperature_2m) {DAY} AS diurnal_amplitude,
    avg(temperature_2m) FILTER (local_date = target_local_date AND hour BETWEEN 11 AND 15) AS midday_temp, avg(cloud_cover) {DAY} AS cloud_cover_mean, avg(wind_speed_10m) {DAY} AS wind_speed_mean,
    avg(relative_humidity_2m) {DAY} AS humidity_mean, avg(dew_point_2m) {DAY} AS dew_point_mean, count(*) {DAY} AS num_hours, max(issue_time_utc) AS latest_issue FROM hourly GROUP BY ALL)"""
FEATS = ["model_daily_max", "model_daily_mean", "model_daily_min", "diurnal_amplitude", "midday_temp", "cloud_cover_mean", "wind_speed_mean", "humidity_mean", "dew_point_mean"]
ROUNDS = ", ".join(f"round({c}, 9) AS {c}" for c in FEATS)


@query("a01_daily_features", with_roles("hourly", f"WITH {A1_SQL} SELECT market_id, model_name, endpoint_kind, dh_key, {ROUNDS}, num_hours, epoch_us(latest_issue) AS issue_us FROM a1"))
def a01(spark, sf):
    """Target-day aggregates per market, model, endpoint and horizon in one pass."""
    out = rounded(X.daily_features(roles.hourly(spark, sf)), *FEATS, digits=9)
    return out.withColumn("issue_us", F.unix_micros("latest_issue_time_utc")).drop("latest_issue_time_utc")


@query(
    "a02_midday_fallback",
    with_roles("hourly", f"WITH {A1_SQL} SELECT market_id, model_name, endpoint_kind, dh_key, round(coalesce(midday_temp, model_daily_mean), 6) AS midday_temp FROM a1"),
)
def a02(spark, sf):
    out = X.with_midday_fallback(X.daily_features(roles.hourly(spark, sf)))
    return out.select("market_id", "model_name", "endpoint_kind", "dh_key", F.round("midday_temp", 6).alias("midday_temp"))


VALID = """coalesce(num_hours > 0 AND model_daily_max IS NOT NULL AND model_daily_mean IS NOT NULL AND model_daily_min IS NOT NULL AND NOT (abs(model_daily_max) <= 1e-9 AND abs(model_daily_mean) <= 1e-9
    AND abs(model_daily_min) <= 1e-9 AND abs(coalesce(diurnal_amplitude, 0)) <= 1e-9), false)"""


@query(
    "s19_feature_validity",
    with_roles("hourly", f"WITH {A1_SQL} SELECT endpoint_kind, {VALID} AS valid, num_hours > 0 AND model_daily_max IS NULL AS missing_temperatures, count(*) AS n FROM a1 GROUP BY ALL"),
)
def s19(spark, sf):
    d = X.daily_features(roles.hourly(spark, sf))
    return d.groupBy("endpoint_kind", X.features_valid().alias("valid"), X.temperatures_missing().alias("missing_temperatures")).agg(F.count("*").alias("n"))


J10_SQL = f"""{A1_SQL}, dec AS (SELECT CAST(s_suppkey AS VARCHAR) AS market_id, h.decision_horizon, TIMESTAMP '1999-01-01' + to_days(CAST(s_nationkey AS INT) * 30) AS issue_by FROM supplier,
    (VALUES ('market_open'), ('previous_evening'), ('morning_of')) h(decision_horizon)),
  c AS (SELECT a1.*, dec.decision_horizon, issue_by, {VALID} AS valid, num_hours > 0 AND model_daily_max IS NULL AS missing FROM a1 JOIN dec USING (market_id)
    WHERE (endpoint_kind = 'single_run' AND dh_key = dec.decision_horizon) OR (endpoint_kind <> 'single_run' AND dh_key = '__historical__')),
  e AS (SELECT *, bool_or(endpoint_kind = 'single_run' AND missing) OVER (PARTITION BY market_id, model_name, decision_horizon) AS empty_run FROM c),
  sel AS (SELECT * FROM e WHERE valid AND (endpoint_kind <> 'historical_forecast' OR latest_issue <= issue_by OR (latest_issue IS NULL AND empty_run))
    QUALIFY row_number() OVER (PARTITION BY market_id, model_name, decision_horizon ORDER BY CASE endpoint_kind WHEN 'single_run' THEN 1 WHEN 'fixture' THEN 2 ELSE 3 END) = 1)"""


def decisions(spark, sf):
    horizons = F.array(*[F.lit(h) for h in ("market_open", "previous_evening", "morning_of")])
    start = F.lit("1999-01-01").cast("date")
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("market_id"),
        F.explode(horizons).alias("decision_horizon"),
        F.date_add(start, F.col("s_nationkey") * 30).cast("timestamp").alias("issue_time_utc"),
    )


def selected(spark, sf):
    return X.select_sources(X.daily_features(roles.hourly(spark, sf)), decisions(spark, sf))


@query("j10_source_selection", with_roles("hourly", f"WITH {J10_SQL} SELECT market_id, model_name, decision_horizon, endpoint_kind, {ROUNDS}, num_hours FROM sel"))
def j10(spark, sf):
    """Best admissible forecast source per decision and model."""
    return rounded(selected(spark, sf), *FEATS, digits=9).drop("latest_issue_time_utc")


@query(
    "j11_hourly_of_selected",
    with_roles(
        "hourly",
        f"""WITH {J10_SQL} SELECT sel.market_id, sel.model_name, sel.decision_horizon AS for_horizon, count(*) AS hours, round(avg(h.cloud_cover), 6) AS cloud FROM hourly h JOIN sel
    ON h.market_id = sel.market_id AND h.model_name = sel.model_name AND h.endpoint_kind = sel.endpoint_kind
    WHERE CASE WHEN sel.endpoint_kind = 'single_run' THEN h.decision_horizon = sel.decision_horizon ELSE h.decision_horizon IS NULL END GROUP BY ALL""",
    ),
)
def j11(spark, sf):
    out = X.hourly_of_selected(roles.hourly(spark, sf), selected(spark, sf))
    return out.groupBy("market_id", "model_name", "for_horizon").agg(F.count("*").alias("hours"), F.round(F.avg("cloud_cover"), 6).alias("cloud"))


@query(
    "j22_tiered_sources",
    with_roles(
        "hourly",
        """WITH t AS (SELECT market_id, CASE WHEN bool_or(endpoint_kind = 'single_run' AND coalesce(decision_horizon = 'market_open', false) AND coalesce(temperature_2m, 1) <> 0) THEN 1
        WHEN bool_or(endpoint_kind = 'historical_forecast') THEN 2 WHEN bool_or(decision_horizon IS NULL) THEN 3 ELSE 4 END AS tier FROM hourly GROUP BY 1)
    SELECT market_id, count(*) AS hours, round(avg(cloud_cover), 6) AS cloud FROM hourly JOIN t USING (market_id)
    WHERE CASE tier WHEN 1 THEN endpoint_kind = 'single_run' AND coalesce(decision_horizon = 'market_open', false) WHEN 2 THEN endpoint_kind = 'historical_forecast' WHEN 3 THEN decision_horizon IS NULL ELSE true END GROUP BY 1""",
    ),
)
def j22(spark, sf):
    out = X.tiered_rows(roles.hourly(spark, sf), ["market_id"], "market_open")
    return out.groupBy("market_id").agg(F.count("*").alias("hours"), F.round(F.avg("cloud_cover"), 6).alias("cloud"))


BIN_ROWS = [("<=5", None, 5.0), ("6-10", 6.0, 10.0), ("11-20", 11.0, 20.0), ("21", 21.0, 21.0), ("22-35", 22.0, 35.0), (">=36", 36.0, None)]
BINS_SQL = "bins AS (SELECT * FROM (VALUES (0, '<=5', NULL, 5.0), (1, '6-10', 6.0, 10.0), (2, '11-20', 11.0, 20.0), (3, '21', 21.0, 21.0), (4, '22-35', 22.0, 35.0), (5, '>=36', 36.0, NULL)) b(ordinal, label, lower, upper))"

TRAIN_SQL = f"""{A1_SQL}, mk AS (SELECT CAST(s_suppkey AS VARCHAR) AS market_id, CASE WHEN s_nationkey < 12 THEN 'Asia/Seoul' ELSE 'America/New_York' END AS zone, CASE WHEN s_nationkey < 12 THEN 'C' ELSE 'F' END AS unit,
    DATE '1999-01-01' + CAST(s_nationkey AS INT) * 30 AS target_date, abs(s_acctbal) / 250 AS daily_max FROM supplier),
  dec AS (SELECT mk.*, h.decision_horizon, timezone(zone, CAST(target_date + h.d AS TIMESTAMP) + to_hours(h.hr)) AT TIME ZONE 'UTC' AS decision_time FROM mk, (VALUES ('market_open', -2, 12), ('previous_evening', -1, 18), ('morning_of', 0, 6)) h(decision_horizon, d, hr)),
  c AS (SELECT a1.*, dec.decision_horizon, decision_time - INTERVAL 6 HOURS AS issue_by, {VALID} AS valid, num_hours > 0 AND model_daily_max IS NULL AS missing FROM a1 JOIN dec USING (market_id)
    WHERE (endpoint_kind = 'single_run' AND dh_key = dec.decision_horizon) OR (endpoint_kind <> 'single_run' AND dh_key = '__historical__')),
  e AS (SELECT *, bool_or(endpoint_kind = 'single_run' AND missing) OVER (PARTITION BY market_id, model_name, decision_horizon) AS empty_run FROM c),
  sel AS (SELECT * FROM e WHERE valid AND (endpoint_kind <> 'historical_forecast' OR latest_issue <= issue_by OR (latest_issue IS NULL AND empty_run))
    QUALIFY row_number() OVER (PARTITION BY market_id, model_name, decision_horizon ORDER BY CASE endpoint_kind WHEN 'single_run' THEN 1 WHEN 'fixture' THEN 2 ELSE 3 END) = 1),
  w AS (SELECT market_id, decision_horizon, max(latest_issue) AS latest_issue, max(endpoint_kind = 'single_run') AS single, count(*) AS n_models,
    max(model_daily_max) FILTER (model_name = 'A') AS a_max, max(model_daily_max) FILTER (model_name = 'N') AS n_max, max(model_daily_max) FILTER (model_name = 'R') AS r_max, max(diurnal_amplitude) FILTER (model_name = 'A') AS a_amp FROM sel GROUP BY ALL)"""


def train(spark, sf):
    far = F.col("s_nationkey") >= 12
    s = table(spark, sf, "supplier")
    markets = s.select(
        F.col("s_suppkey").cast("string").alias("market_id"),
        F.when(far, "America/New_York").otherwise("Asia/Seoul").alias("timezone"),
        F.when(far, "F").otherwise("C").alias("unit"),
        F.date_add(F.lit("1999-01-01").cast("date"), F.col("s_nationkey") * 30).alias("target_date"),
        B.bin_array(BIN_ROWS).alias("bins"),
    )
    truth = s.select(F.col("s_suppkey").cast("string").alias("market_id"), (F.abs("s_acctbal") / 250).alias("daily_max"))
    return X.training_rows(markets, truth, roles.hourly(spark, sf), ["A", "N", "R"], ["market_open", "previous_evening", "morning_of"])


@query(
    "a01_training_rows",
    with_roles(
        "hourly",
        f"""WITH {TRAIN_SQL}, {BINS_SQL} SELECT w.market_id, w.decision_horizon, epoch_us(decision_time) AS decision_us, epoch_us(coalesce(w.latest_issue, decision_time - INTERVAL 6 HOURS)) AS issue_us, CAST(n_models AS INT) AS n_models,
    CASE WHEN single THEN 'single_run' ELSE 'historical_forecast' END AS forecast_source_kind, round(CASE WHEN unit = 'F' THEN coalesce(a_max, n_max, r_max) * 9 / 5 + 32 ELSE coalesce(a_max, n_max, r_max) END, 6) AS model_daily_max,
    round(CASE WHEN unit = 'F' THEN a_amp * 9 / 5 ELSE a_amp END, 6) AS a_amp,
    (SELECT arg_min(label, ordinal) FROM bins WHERE daily_max >= coalesce(lower - 0.5, -1e9) AND daily_max < coalesce(upper + 0.5, 1e9)) AS winning_outcome, w.market_id || '|' || strftime(target_date, '%Y-%m-%d') AS group_id
    FROM w JOIN dec ON dec.market_id = w.market_id AND dec.decision_horizon = w.decision_horizon""",
    ),
)
def a01t(spark, sf):
    """Leakage-safe training rows per market and horizon, one plan end to end."""
    t = train(spark, sf)
    return t.select(
        "market_id",
        "decision_horizon",
        F.unix_micros("decision_time_utc").alias("decision_us"),
        F.unix_micros("issue_time_utc").alias("issue_us"),
        F.size("selected_models").alias("n_models"),
        "forecast_source_kind",
        F.round("model_daily_max", 6).alias("model_daily_max"),
        F.round("A_diurnal_amplitude", 6).alias("a_amp"),
        "winning_outcome",
        "group_id",
    )


@query(
    "s17_neighbor_features",
    with_roles(
        "hourly",
        f"""WITH {TRAIN_SQL} SELECT market_id, decision_horizon, round(CASE WHEN unit = 'F' THEN coalesce(n_max, coalesce(a_max, n_max, r_max)) * 9 / 5 + 32 ELSE coalesce(n_max, coalesce(a_max, n_max, r_max)) END, 6) AS neighbor_mean_temp,
    round(abs(a_max - n_max) * CASE WHEN unit = 'F' THEN 9.0 / 5 ELSE 1 END, 6) AS neighbor_spread FROM w JOIN mk USING (market_id)""",
    ),
)
def s17(spark, sf):
    out = X.neighbor_features(train(spark, sf), "N_model_daily_max", "model_daily_max", ("A_model_daily_max", "N_model_daily_max"))
    return out.select("market_id", "decision_horizon", F.round("neighbor_mean_temp", 6).alias("neighbor_mean_temp"), F.round("neighbor_spread", 6).alias("neighbor_spread"))


@query(
    "s39_sequence_rows",
    """SELECT l_orderkey, count(*)::INT AS sequence_length, string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ',' ORDER BY l_shipdate, l_quantity, l_discount) AS quantities,
    round(sum(l_discount), 6) AS discount_sum FROM lineitem GROUP BY 1""",
)
def s39(spark, sf):
    """Ordered value arrays per group with length and mask."""
    out = X.sequence_rows(table(spark, sf, "lineitem"), ["l_orderkey"], "l_shipdate", ["l_quantity", "l_discount"])
    return out.select(
        "l_orderkey",
        "sequence_length",
        F.array_join(F.transform("l_quantity", lambda q: q.cast("bigint").cast("string")), ",").alias("quantities"),
        F.round(N.array_sum(F.col("l_discount")), 6).alias("discount_sum"),
    )


@query(
    "a03_station_day_rows",
    """SELECT l_orderkey, l_returnflag, round(min(l_quantity) FILTER (l_linestatus = 'F'), 6) AS forecast_min, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS forecast_mean, round(max(l_quantity) FILTER (l_linestatus = 'F'), 6) AS forecast_max,
    round(max(l_quantity) FILTER (l_linestatus = 'O'), 6) AS observed_max, round(avg(l_tax) FILTER (l_linestatus = 'F'), 6) AS l_tax_mean,
    '[' || coalesce(string_agg(CAST(l_quantity AS VARCHAR), ',' ORDER BY l_shipdate, l_quantity) FILTER (l_linestatus = 'F'), '') || ']' AS hourly_json FROM lineitem GROUP BY ALL""",
)
def a03(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("source", F.when(F.col("l_linestatus") == "F", "forecast").otherwise("observation"))
    out = X.station_day_rows(li, ["l_orderkey", "l_returnflag"], "source", "l_quantity", "l_shipdate", ["l_tax"])
    return rounded(out, "forecast_mean", "l_tax_mean")


@query(
    "a44_ensemble_statistics",
    """WITH p AS (SELECT l_suppkey, l_returnflag, l_linenumber, max(l_extendedprice) AS peak FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, l_returnflag, count(*) AS members, round(avg(peak), 4) AS ensemble_mean, round(stddev_pop(peak), 4) AS ensemble_std, round(max(peak) - min(peak), 4) AS ensemble_range FROM p GROUP BY ALL""",
)
def a44(spark, sf):
    out = X.ensemble_statistics(table(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag"], "l_linenumber", "l_extendedprice")
    return rounded(out, "ensemble_mean", "ensemble_std", "ensemble_range", digits=4)


@query(
    "s44_trajectory_max",
    """SELECT vec_id, round(list_max(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS daily_max, round(list_max(list_transform(embedding[1:24], lambda x: x::DOUBLE)), 6) AS first_day_max FROM embeddings""",
)
def s44(spark, sf):
    """Daily maximum of trajectories held as arrays; the first day is 24 hours."""
    e = table(spark, sf, "embeddings").withColumn("t", F.transform("embedding", lambda v: v.cast("double")))
    days = F.array(F.slice("t", 1, 24), F.col("t"))
    return e.withColumn("m", X.daily_max(days)).select("vec_id", F.round(F.col("m")[1], 6).alias("daily_max"), F.round(F.col("m")[0], 6).alias("first_day_max"))


# --- climate -----------------------------------------------------------------------

NORMALS_SQL = "normals AS (SELECT city, month(target_date) AS m, count(*) AS n, avg(y) AS clim_mean, greatest(stddev_samp(y), 0.5) AS clim_std, avg(y - mean) AS bias FROM preds GROUP BY ALL HAVING count(*) >= 5)"


@query("a36_climate_normals", with_roles("preds", f"WITH {NORMALS_SQL} SELECT city, CAST(m AS INT) AS month, n, round(clim_mean, 6) AS clim_mean, round(clim_std, 6) AS clim_std, round(bias, 6) AS forecast_bias FROM normals"))
def a36(spark, sf):
    out = X.climate_normals(roles.preds(spark, sf), "city", "target_date", "y", "mean")
    return rounded(out, "clim_mean", "clim_std", "forecast_bias")


@query(
    "s16_climate_features",
    with_roles(
        "preds",
        f"""WITH {NORMALS_SQL} SELECT p.city, decision_horizon, count(*) AS n, round(avg(mean - clim_mean), 6) AS clim_delta, round(avg(abs((mean - clim_mean) / clim_std)), 6) AS abs_zscore, round(avg(mean + bias), 6) AS bias_corrected
    FROM preds p JOIN normals s ON s.city = p.city AND s.m = month(target_date) GROUP BY ALL""",
    ),
)
def s16(spark, sf):
    p = roles.preds(spark, sf)
    out = X.climate_features(p, X.climate_normals(p, "city", "target_date", "y", "mean"), "city", "target_date", "mean")
    return out.groupBy("city", "decision_horizon").agg(
        F.count("*").alias("n"),
        F.round(F.avg("clim_delta"), 6).alias("clim_delta"),
        F.round(F.avg(F.abs("clim_zscore")), 6).alias("abs_zscore"),
        F.round(F.avg("bias_corrected"), 6).alias("bias_corrected"),
    )


@query(
    "j12_climatology",
    with_roles(
        "preds",
        """WITH t AS (SELECT city, month(target_date) AS m, day(target_date) AS d, avg(y) AS mean, greatest(coalesce(stddev_samp(y), 3), 0.5) AS std FROM preds WHERE decision_horizon = '1-URGENT' GROUP BY ALL),
    g AS (SELECT avg(y) AS gm, stddev_samp(y) AS gs FROM preds)
    SELECT p.city, p.decision_horizon, count(*) AS n, count(t.mean) AS matched, round(avg(coalesce(t.mean, gm)), 6) AS mean, round(avg(coalesce(t.std, gs)), 6) AS std
    FROM preds p CROSS JOIN g LEFT JOIN t ON t.city = p.city AND t.m = month(target_date) AND t.d = day(target_date) GROUP BY ALL""",
    ),
)
def j12(spark, sf):
    """Station-day climatology of one horizon applied to all, global fallback."""
    p = roles.preds(spark, sf)
    t = X.climatology(p.where(F.col("decision_horizon") == "1-URGENT"), "city", "target_date", "y")
    base = p.select("city", "decision_horizon", "target_date").withColumn("gm", p.agg(F.avg("y")).scalar()).withColumn("gs", p.agg(F.stddev_samp("y")).scalar())
    hits = t.select("city", F.col("month").alias("hm"), F.col("day").alias("hd"))
    out = X.climatology_predict(base, t, "city", "target_date", F.col("gm"), F.col("gs"))
    seen = base.select("city", "decision_horizon", F.month("target_date").alias("hm"), F.dayofmonth("target_date").alias("hd")).join(hits, ["city", "hm", "hd"], "left_semi")
    matched = seen.groupBy("city", "decision_horizon").agg(F.count("*").alias("matched"))
    agg = out.groupBy("city", "decision_horizon").agg(F.count("*").alias("n"), F.round(F.avg("mean"), 6).alias("mean"), F.round(F.avg("std"), 6).alias("std"))
    return agg.join(matched, ["city", "decision_horizon"], "left").fillna(0, subset=["matched"])


# --- design columns ------------------------------------------------------------------


@query(
    "a37_feature_medians",
    """SELECT feature, round(median(value), 6) AS median FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem) GROUP BY 1""",
)
def a37(spark, sf):
    """Exact medians of all features in one job."""
    out = X.feature_medians(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(out, "median")


@query(
    "f09_feature_selection",
    """SELECT column_name AS feature FROM (SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS column_name,
    unnest([count(DISTINCT l_orderkey), count(DISTINCT l_partkey), count(DISTINCT l_suppkey), count(DISTINCT l_linenumber), count(DISTINCT l_quantity), count(DISTINCT l_extendedprice), count(DISTINCT l_discount), count(DISTINCT l_tax)]) AS n FROM lineitem) WHERE n > 1 AND column_name NOT LIKE '%key'""",
)
def f09(spark, sf):
    """Numeric, varying columns without the excluded suffix."""
    names = X.select_features(table(spark, sf, "lineitem").withColumn("constant", F.lit(1.0)), suffixes=["key"])
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query(
    "s10_one_hot",
    """SELECT o_custkey, CAST(sum(CAST(o_orderpriority = '1-URGENT' AS INT)) AS DOUBLE) AS p__1_urgent, CAST(sum(CAST(o_orderpriority = '4-NOT SPECIFIED' AS INT)) AS DOUBLE) AS p__4_not_specified FROM orders GROUP BY 1""",
)
def s10(spark, sf):
    o = X.one_hot(table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "4-NOT SPECIFIED"], "p")
    return o.groupBy("o_custkey").agg(*[F.sum(c).alias(c) for c in ("p__1_urgent", "p__4_not_specified")])


@query(
    "s10_city_month",
    with_roles("preds", "SELECT decision_horizon, CAST(count(*) FILTER (city = 'NATION_1' AND month(target_date) = 3) AS DOUBLE) AS cm__nation_1__m03, CAST(count(*) FILTER (city = 'NATION_2' AND month(target_date) = 12) AS DOUBLE) AS cm__nation_2__m12 FROM preds GROUP BY 1"),
)
def s10c(spark, sf):
    p = X.city_month_dummies(roles.preds(spark, sf), "city", "target_date", ["NATION_1", "NATION_2"])
    return p.groupBy("decision_horizon").agg(*[F.sum(c).alias(c) for c in ("cm__nation_1__m03", "cm__nation_2__m12")])


@query(
    "s11_availability",
    with_roles(
        "hourly",
        """WITH a AS (SELECT model_name, temperature_2m, wind_speed_10m, CASE WHEN endpoint_kind = 'fixture' THEN true ELSE temperature_2m IS NOT NULL END AS ta FROM hourly)
    SELECT model_name, CAST(count(*) FILTER (temperature_2m IS NULL) AS DOUBLE) AS miss__temperature_2m, CAST(count(*) FILTER (ta) AS DOUBLE) AS avail__temperature_2m, round(avg((CAST(ta AS INT) + 1) / 2.0), 6) AS fraction FROM a GROUP BY 1""",
    ),
)
def s11(spark, sf):
    """Missing and availability indicators; a JSON map overrides the value."""
    h = roles.hourly(spark, sf).withColumn("avail_json", F.when(F.col("endpoint_kind") == "fixture", '{"temperature_2m": true}'))
    out = X.availability(h, ["temperature_2m", "wind_speed_10m"], "avail_json")
    return out.groupBy("model_name").agg(
        F.sum("miss__temperature_2m").alias("miss__temperature_2m"),
        F.sum("avail__temperature_2m").alias("avail__temperature_2m"),
        F.round(F.avg("available_feature_fraction"), 6).alias("fraction"),
    )


@query(
    "s12_model_spreads",
    """WITH m AS (SELECT l_orderkey, max(l_quantity) FILTER (l_returnflag = 'A') AS a, max(l_quantity) FILTER (l_returnflag = 'N') AS n, max(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
    SELECT l_orderkey, coalesce(greatest(a, n, r) - least(a, n, r), 0) AS nwp_spread, round((SELECT stddev_pop(v) FROM (VALUES (a), (n), (r)) t(v)), 6) AS nwp_std, round((SELECT avg(v) FROM (VALUES (a), (n), (r)) t(v)), 6) AS nwp_ens_mean,
    coalesce(a - n, 0) AS a_n_diff FROM m""",
)
def s12(spark, sf):
    """Spread, deviation and mean across model columns, nulls skipped."""
    li = table(spark, sf, "lineitem")
    wide = li.groupBy("l_orderkey").agg(*[F.max(F.when(F.col("l_returnflag") == m, F.col("l_quantity"))).alias(m) for m in "ANR"])
    out = X.pair_differences(X.spread_features(wide, ["A", "N", "R"]), {"a_n_diff": ("A", "N")})
    return rounded(out, "nwp_std", "nwp_ens_mean").drop("A", "N", "R")


@query(
    "s13_source_range",
    """SELECT l_linestatus, count(*) AS n, round(avg(greatest(l_quantity, l_extendedprice / 2000) - least(l_quantity, l_extendedprice / 2000)) * CASE WHEN l_linestatus = 'F' THEN 5.0 / 9 ELSE 1 END, 6) AS source_range,
    CAST(sum(CAST(abs(l_quantity - CASE WHEN l_linestatus = 'F' THEN 32 ELSE 0 END) <= 0.2 + CASE WHEN l_linestatus = 'F' THEN 32e-5 ELSE 0 END AS INT) + CAST(abs(l_extendedprice / 2000 - CASE WHEN l_linestatus = 'F' THEN 32 ELSE 0 END) <= 0.2 + CASE WHEN l_linestatus = 'F' THEN 32e-5 ELSE 0 END AS INT)) AS BIGINT) AS sentinels
    FROM lineitem GROUP BY 1""",
)
def s13(spark, sf):
    """Range across sources in Celsius, and columns that look like a stored zero."""
    li = table(spark, sf, "lineitem").withColumn("p", F.col("l_extendedprice") / 2000)
    unit = F.when(F.col("l_linestatus") == "F", "F").otherwise("C")
    cols = ["l_quantity", "p"]
    return li.groupBy("l_linestatus").agg(
        F.count("*").alias("n"),
        F.round(F.avg(X.source_range_celsius(cols, unit)), 6).alias("source_range"),
        F.sum(X.sentinel_count(cols, unit)).alias("sentinels"),
    )


@query("s14_sentinel_counts", """SELECT l_suppkey, CAST(count(*) FILTER (abs(l_quantity - CASE WHEN l_linestatus = 'F' THEN 32 ELSE 0 END) <= 1.5 + CASE WHEN l_linestatus = 'F' THEN 32e-5 ELSE 0 END) AS BIGINT) AS sentinels FROM lineitem GROUP BY 1""")
def s14(spark, sf):
    unit = F.when(F.col("l_linestatus") == "F", "F").otherwise("C")
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum(X.sentinel_count(["l_quantity"], unit, 1.5)).alias("sentinels"))


@query(
    "s15_weather_interactions",
    with_roles("hourly", f"WITH {A1_SQL} SELECT market_id, model_name, endpoint_kind, dh_key, round(cloud_cover_mean * diurnal_amplitude, 6) AS wx_cloud_diurnal, round(model_daily_max - dew_point_mean, 9) AS wx_dew_depression, round(model_daily_max * humidity_mean / 100, 6) AS wx_heat_index_proxy, round(wind_speed_mean * diurnal_amplitude, 6) AS wx_wind_diurnal FROM a1"),
)
def s15(spark, sf):
    out = X.weather_interactions(X.daily_features(roles.hourly(spark, sf)))
    names = ["wx_cloud_diurnal", "wx_dew_depression", "wx_heat_index_proxy", "wx_wind_diurnal"]
    out = rounded(rounded(out, "wx_cloud_diurnal", "wx_heat_index_proxy", "wx_wind_diurnal"), "wx_dew_depression", digits=9)
    return out.select("market_id", "model_name", "endpoint_kind", "dh_key", *names)


@query(
    "s05_unit_conversion",
    with_roles(
        "preds",
        """SELECT unit, city, round(avg(CASE WHEN unit = 'F' THEN (mean - 32) * 5 / 9 ELSE mean END), 6) AS mean_c, round(avg(CASE WHEN unit = 'F' THEN std * 5 / 9 ELSE std END), 6) AS std_c,
    round(avg(CASE WHEN unit = 'F' THEN mean * 9 / 5 + 32 ELSE mean END), 6) AS mean_f FROM preds GROUP BY ALL""",
    ),
)
def s05(spark, sf):
    u = F.col("unit")
    return roles.preds(spark, sf).groupBy("unit", "city").agg(
        F.round(F.avg(N.to_celsius(F.col("mean"), u)), 6).alias("mean_c"),
        F.round(F.avg(N.to_celsius(F.col("std"), u, scale=True)), 6).alias("std_c"),
        F.round(F.avg(N.from_celsius(F.col("mean"), u)), 6).alias("mean_f"),
    )


@query(
    "s18_neighbor_deltas",
    """WITH m AS (SELECT l_orderkey, avg(l_quantity) AS own, max(l_extendedprice) / 2000 AS nb, CASE WHEN count(*) > 2 THEN max(l_discount) END AS sp, stddev_pop(l_quantity) AS sd FROM lineitem GROUP BY 1)
    SELECT l_orderkey, round(own - nb, 6) AS neighbor_delta, round(sd - coalesce(sp, 0), 6) AS spread_delta FROM m""",
)
def s18(spark, sf):
    m = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.avg("l_quantity").alias("own"),
        (F.max("l_extendedprice") / 2000).alias("nb"),
        F.when(F.count("*") > 2, F.max("l_discount")).alias("sp"),
        F.stddev_pop("l_quantity").alias("sd"),
    )
    m = m.fillna(0.0, subset=["nb", "sp"])
    out = X.pair_differences(m, {"neighbor_delta": ("own", "nb"), "spread_delta": ("sd", "sp")})
    return rounded(out, "neighbor_delta", "spread_delta").select("l_orderkey", "neighbor_delta", "spread_delta")


@query("s46_align_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, CAST(0 AS DOUBLE) AS absent, l_tax FROM lineitem")
def s46(spark, sf):
    """Exactly the fitted columns, absent ones filled."""
    return X.align(table(spark, sf, "lineitem"), ["l_quantity", "absent", "l_tax"], 0.0, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])


@query(
    "j17_city_latitude",
    with_roles("cities", "SELECT c_custkey, round(coalesce(CASE WHEN nationkey < 20 THEN nationkey * 3.0 - 20 END / 90, 0), 6) AS city_latitude FROM cities"),
)
def j17(spark, sf):
    st = table(spark, sf, "nation").where(F.col("n_nationkey") < 20).select(F.col("n_name").alias("city"), (F.col("n_nationkey") * 3.0 - 20).alias("lat"))
    out = X.city_latitude(roles.cities(spark, sf), st, "city")
    return out.select("c_custkey", F.round("city_latitude", 6).alias("city_latitude"))


@query(
    "j16_station_enrichment",
    """WITH m AS (SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'st' || s_nationkey END AS station_id, CASE WHEN s_acctbal < 2000 THEN 'ALIAS_' || s_nationkey ELSE lower(n_name) END AS city FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    st AS (SELECT 'ST' || n_nationkey AS station_id, n_name AS city, 'alias_' || n_nationkey AS alias, n_nationkey * 2.5 AS lat, r_name AS tz FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT s_suppkey, round(coalesce(a.lat, b.lat), 4) AS lat, coalesce(a.tz, b.tz) AS tz FROM m LEFT JOIN st a ON lower(a.station_id) = lower(m.station_id) LEFT JOIN st b ON lower(m.city) IN (lower(b.city), b.alias)""",
)
def j16(spark, sf):
    """Station columns by id, else by city alias."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    st = n.select(
        F.concat(F.lit("ST"), "n_nationkey").alias("station_id"),
        F.col("n_name").alias("city"),
        F.array(F.concat(F.lit("Alias_"), "n_nationkey")).alias("aliases"),
        (F.col("n_nationkey") * 2.5).alias("lat"),
        F.col("r_name").alias("tz"),
    )
    m = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey",
        F.when(F.col("s_acctbal") > 5000, F.concat(F.lit("st"), "s_nationkey")).alias("station_id"),
        F.when(F.col("s_acctbal") < 2000, F.concat(F.lit("ALIAS_"), "s_nationkey")).otherwise(F.lower("n_name")).alias("city"),
    )
    return X.enrich_station(m, st, ["lat", "tz"]).select("s_suppkey", F.round("lat", 4).alias("lat"), "tz")
