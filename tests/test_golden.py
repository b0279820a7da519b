"""Hand-computed cases of the semantics that are easy to get wrong."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from skyledger.functions import clock as C
from skyledger.functions import labels as L
from skyledger.functions import numeric as N
from skyledger.operators import asof, bins as B, folds, merge, quantiles, reports as R, scoring as S, trade as X, windows as W


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def ts(text):
    return dt.datetime.fromisoformat(text)


def panel(spark, ticks, decisions, minutes=720):
    t = spark.createDataFrame(ticks, "m string, token string, at timestamp, price double, seq long")
    d = spark.createDataFrame(decisions, "m string, token string, id long, decided timestamp")
    out = asof.price_panel(d, t, ["m", "token"], "decided", "at", "price", minutes, sequence="seq", slice_seconds=3600)
    return {r["id"]: r for r in out.collect()}


def test_asof_stale_boundary_null_price_equal_time_and_null_time(spark):
    ticks = [
        ("a", "x", ts("2025-01-01 08:00:00"), 0.42, 1),
        ("b", "x", ts("2025-01-01 08:00:00"), 0.40, 1),
        ("b", "x", ts("2025-01-01 09:00:00"), None, 2),
        ("c", "x", ts("2025-01-01 10:00:00"), 0.50, 1),
        ("d", "x", None, 0.9, 1),
        ("e", "x", ts("2025-01-01 10:00:00"), 0.1, 1),
        ("e", "x", ts("2025-01-01 10:00:00"), 0.2, 2),
    ]
    decisions = [
        ("a", "x", 1, ts("2025-01-01 20:00:00")),
        ("a", "x", 2, ts("2025-01-01 20:00:01")),
        ("b", "x", 3, ts("2025-01-01 09:30:00")),
        ("c", "x", 4, ts("2025-01-01 10:00:00")),
        ("d", "x", 5, ts("2025-01-01 10:00:00")),
        ("a", "x", 6, ts("2025-01-01 07:59:59")),
        ("e", "x", 7, ts("2025-01-03 00:00:00")),
        ("a", "x", 8, None),
    ]
    got = panel(spark, ticks, decisions)
    assert got[1]["coverage_status"] == "ok" and got[1]["price_age_seconds"] == 43200
    assert got[2]["coverage_status"] == "stale"
    assert got[3]["coverage_status"] == "missing" and got[3]["market_price"] is None
    assert got[4]["coverage_status"] == "ok" and got[4]["price_age_seconds"] == 0
    assert got[5]["coverage_status"] == "missing"
    assert got[6]["coverage_status"] == "missing"
    assert got[7]["market_price"] == 0.2
    assert 8 not in got


def test_label_token_lists_are_cut_to_the_shorter(spark):
    d = spark.createDataFrame([(1, ["a", "b", "c"], ["x", "y"])], "id long, labels array<string>, tokens array<string>")
    rows = asof.decision_tokens(d, "labels", "tokens").collect()
    assert [(r["outcome_label"], r["token_id"]) for r in rows] == [("a", "x"), ("b", "y")]


def test_keep_last_keeps_the_null_time_and_null_keys(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", None, "null"), (None, 1, "n1"), (None, 2, "n2")], "k string, t int, v string")
    got = {r["k"]: r["v"] for r in merge.keep_last(df, ["k"], ["t"]).collect()}
    assert got == {"k": "null", None: "n2"}


def test_upsert_null_key_new_column_and_widening(spark):
    target = spark.createDataFrame([("m1", None, 1)], "m string, h string, x int")
    new = spark.createDataFrame([("m1", None, 2.5, "a", 1), ("m1", None, 3.5, "b", 2)], "m string, h string, x double, note string, seq int")
    rows = merge.upsert(target, new, ["m", "h"], ["seq"]).collect()
    assert [(r["m"], r["h"], r["x"], r["note"]) for r in rows] == [("m1", None, 3.5, "b")]


TEN = [("<=7", None, 7.0), ("8", 8.0, 8.0), (">=9", 9.0, None)]


@pytest.mark.parametrize("v,label", [(7.49, "<=7"), (7.5, "8"), (8.5, ">=9")])
def test_winning_bin(spark, v, label):
    assert value(spark, B.winning_label(B.bin_array(TEN), F.lit(v))) == label


def test_range_bins_do_not_overlap(spark):
    bins = B.bin_array([("35-36", 35.0, 36.0), ("37-38", 37.0, 38.0)])
    assert value(spark, B.winning_label(bins, F.lit(36.5))) == "37-38"
    assert value(spark, B.winning_label(bins, F.lit(99.0))) is None


def test_normalize_without_mass_is_uniform(spark):
    assert value(spark, B.normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.5, 0.5]


def test_normal_masses_sum_to_one_and_match_erf(spark):
    got = value(spark, B.normal_masses(B.bin_array(TEN), F.lit(8.2), F.lit(1.3)))
    cdf = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    want = [cdf((7.5 - 8.2) / 1.3), cdf((8.5 - 8.2) / 1.3) - cdf((7.5 - 8.2) / 1.3), 1 - cdf((8.5 - 8.2) / 1.3)]
    assert sum(got) == pytest.approx(1.0, abs=1e-15)
    assert got == pytest.approx(want, abs=1e-12)


def test_cdf_against_erf(spark):
    zs = [x / 7 for x in range(-80, 81)] + [12.0, -12.0, 40.0, -40.0, 0.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", N.std_normal_cdf(F.col("z")).alias("c"))
    for r in df.collect():
        assert r["c"] == pytest.approx(0.5 * (1 + math.erf(r["z"] / math.sqrt(2))), abs=1e-13)
    import numpy as np

    want = [0.5 * math.erfc(-z / math.sqrt(2)) for z in zs]
    assert np.allclose(N.normal_cdf_array(np.array(zs)), want, atol=1e-13)


def test_brier_and_calibration(spark):
    probs = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(0.5).alias("prob")) for n in "ab"])
    assert value(spark, B.brier(probs, F.lit("a"))) == 0.25
    df = spark.createDataFrame([(1.0, 1.0), (0.55, 1.0)], "p double, y double")
    assert S.calibration_error(df, "p", "y").first()["calibration_error"] == pytest.approx(0.225)


def test_crps(spark):
    assert value(spark, N.sample_crps(F.array(F.lit(0.0), F.lit(2.0)), F.lit(1.0))) == pytest.approx(0.5)
    zero = N.gaussian_crps(F.lit(0.0), F.lit(1.0), F.lit(0.0))
    assert value(spark, zero) == pytest.approx((math.sqrt(2) - 1) / math.sqrt(math.pi), abs=1e-12)


def test_depth_walk(spark):
    asks = F.array(*[F.struct(F.lit(p).alias("price"), F.lit(s).alias("size")) for p, s in ((0.5, 10.0), (0.6, 10.0))])
    assert value(spark, X.book_slippage("buy", asks, F.lit(15.0))) == pytest.approx(1 / 30)
    assert value(spark, X.book_slippage("buy", asks, F.lit(25.0))) is None
    assert value(spark, X.book_slippage("buy", asks, F.lit(0.0))) == 0.0


def test_trailing_stop(spark):
    rows = [("p", ts(f"2025-01-0{i} 00:00:00"), price, 0.5) for i, price in enumerate((0.5, 0.6, 0.47, 0.1), 1)]
    df = spark.createDataFrame(rows, "p string, at timestamp, price double, entry double")
    got = asof.stop_scan(df, ["p"], "at", "price", "entry").collect()
    assert [(r["exit_reason"], r["exit_price"], r["high_water_mark"]) for r in got] == [("trailing_stop", 0.47, 0.6)]


def test_kelly_is_capped(spark):
    assert value(spark, X.capped_kelly(F.lit(0.1), F.lit(0.6), F.lit(1000.0), F.lit(0.5))) == pytest.approx(50.0)
    assert value(spark, X.capped_kelly(F.lit(0.0), F.lit(0.6), F.lit(1000.0), F.lit(0.5))) == 0.0


def test_upper_median_and_linear_median(spark):
    df = spark.createDataFrame([(v,) for v in (4.0, 1.0, 3.0, 2.0)], "v double")
    assert quantiles.grouped_quantiles(df, [], "v", {"m": 0.5}, "upper").first()["m"] == 3.0
    assert quantiles.grouped_quantiles(df, [], "v", {"m": 0.5}).first()["m"] == 2.5


def test_islands(spark):
    df = spark.createDataFrame([(dt.date(2025, 1, d),) for d in (1, 2, 3, 5, 5)], "d date")
    got = sorted((r["start_date"].day, r["end_date"].day) for r in W.date_ranges(df, [], "d").collect())
    assert got == [(1, 3), (5, 5)]


def test_dense_rank_score(spark):
    df = spark.createDataFrame([("a", 0.1), ("b", 0.1), ("c", 0.3)], "model_name string, avg_crps_mean double")
    got = {r["model_name"]: r["champion_score"] for r in S.score_leaderboard(df).collect()}
    assert got == {"a": 0.25, "b": 0.25, "c": 0.5}


def test_expanding_folds(spark):
    rows = [(f"m{i}", dt.date(2025, 1, i), h) for i in (1, 2, 3) for h in ("a", "b")]
    df = spark.createDataFrame(rows, "market_id string, target_date date, decision_horizon string")
    folded = folds.expanding_folds(df, ["market_id", "target_date"], 1, 1)
    sizes = {r["fold"]: (r["train_rows"], r["test_rows"]) for r in folds.fold_sizes(folded, 1, 1).collect()}
    assert sizes == {0: (2, 2), 1: (4, 2)}


def test_decision_points(spark):
    at = lambda h: value(spark, C.decision_point(F.lit("2025-12-11").cast("date"), F.lit(h), F.lit("Asia/Seoul")))
    evening = at("previous_evening")
    assert evening["decision_time_utc"] == ts("2025-12-10 09:00:00")
    assert evening["issue_time_utc"] == ts("2025-12-10 03:00:00")
    assert evening["lead_hours"] == 6.0
    assert at("morning_of")["lead_hours"] == 1.0


def test_clock_changes(spark):
    ny = F.lit("America/New_York")
    local = lambda s: C.local_to_utc(F.lit(s).cast("timestamp_ntz"), ny)
    assert value(spark, local("2025-11-02 01:30:00")) is None
    assert value(spark, local("2025-03-09 02:30:00")) == ts("2025-03-09 07:00:00")
    assert value(spark, local("2025-07-01 12:00:00")) == ts("2025-07-01 16:00:00")


def test_l2_bucket_edge_and_empty_buckets(spark):
    df = spark.createDataFrame([(24.0, 0.2, 1.0, 1.0)], "hours_to_settlement double, spread double, bid_depth double, ask_depth double")
    got = {r["bucket"]: r["count"] for r in R.l2_buckets(df).collect()}
    assert got == {"12-24h": 1, "24-48h": 0, "6-12h": 0, "3-6h": 0, "1-3h": 0, "0-1h": 0}


def test_quote_proxy(spark):
    q = value(spark, X.quote_proxy(F.lit(0.9990), F.lit(0.02)))
    assert q["ask"] == pytest.approx(0.9995) and q["bid"] == pytest.approx(0.979)


@pytest.mark.parametrize(
    "label,lower,upper,unit",
    [
        ("7°C or below", None, 7.0, "C"),
        ("40 °f or higher", 40.0, None, "F"),
        ("35–36°F", 35.0, 36.0, "F"),
        ("-3°C", -3.0, -3.0, "C"),
        ("> 12", 12.0, None, "F"),
        ("≤ 9°C", None, 9.0, "C"),
    ],
)
def test_labels(spark, label, lower, upper, unit):
    got = value(spark, L.parse_label(F.lit(label), F.lit("F")))
    assert (got["lower"], got["upper"], got["unit"], got["error"]) == (lower, upper, unit, None)


def test_bad_label_is_an_error_row(spark):
    assert value(spark, L.parse_label(F.lit("about 7"), F.lit("C")))["error"] == "Unsupported outcome label: about 7"


@pytest.mark.parametrize("text", ["December 11, 2025", "11 Dec 2025", "Thursday, December 11th, 2025", "resolves the 11th of December 2025", "2025-12-11"])
def test_date_texts(spark, text):
    assert value(spark, L.parse_date_text(F.lit(text))) == dt.date(2025, 12, 11)


def test_observation_adjustment(spark):
    bins = B.bin_array(TEN)
    probs = B.labeled(bins, F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)))
    got = value(spark, B.observation_adjusted(bins, probs, F.lit(7.6)))
    assert [p["prob"] for p in got["probs"]] == pytest.approx([0.0, 0.6, 0.4])
    assert got["impossible"] == ["<=7"] and got["removed_mass"] == pytest.approx(0.5)
