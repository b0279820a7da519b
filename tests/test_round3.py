"""Joins and payloads of round 3: the same rows, with work that grows no faster than the tables."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from skyledger.operators import bins as B
from skyledger.operators import reports as R
from skyledger.plans import q_stream, roles
from skyledger.sources import payloads as P


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_join_matches_brute_force(spark):
    rng = random.Random(3)
    bins = [("a", i, f"a{i}", rng.choice([None, rng.randint(0, 50)]), rng.choice([None, rng.randint(0, 60)])) for i in range(40)]
    bins += [("b", 1, "b1", 5.0, 5.0), ("b", 0, "b0", 9.0, 4.0), (None, 0, "none", None, None), ("c", 7, "c7", None, None), ("d", None, "d", None, None)]
    bins = [(k, o, n, None if lo is None else float(lo), None if hi is None else float(hi)) for k, o, n, lo, hi in bins]
    points = [*range(-3, 64), 4.5, 5.5, 5.4999, -1e308, math.inf, -math.inf, math.nan, None]
    values = [(k, None if v is None else float(v)) for k in ("a", "b", "c", "d", "e", None) for v in [*points, 5, 5]]
    out = B.range_join_bins(
        spark.createDataFrame(values, "k string, v double").repartition(3), spark.createDataFrame(bins, "k string, ordinal int, label string, lower double, upper double"), ["k"], "v"
    )

    def first(k, v):
        if k is None or v is None or math.isnan(v):
            return None
        low, high = lambda x: -math.inf if x is None else x - 0.5, lambda x: math.inf if x is None else x + 0.5
        hits = [(o, n) for key, o, n, lo, hi in bins if key == k and o is not None and low(lo) <= v < high(hi)]
        return min(hits)[1] if hits else None

    found = sorted((str(r["k"]), str(r["v"]), str(r["winning_label"])) for r in out.collect())
    assert found == sorted((str(k), str(v), str(first(k, v))) for k, v in values)


def test_range_join_pairs_no_value_with_every_bin(spark):
    n = 400
    bins = spark.range(n).selectExpr("'m' AS k", "id AS ordinal", "concat('b', id) AS label", "CAST(id AS DOUBLE) AS lower", f"CAST({n} AS DOUBLE) AS upper")
    out = B.range_join_bins(spark.range(n).selectExpr("'m' AS k", "CAST(id AS DOUBLE) AS v"), bins, ["k"], "v")
    assert {r["v"]: r["winning_label"] for r in out.collect()} == {float(i): "b0" for i in range(n)}
    joins = [line for line in plan_of(out).splitlines() if "Join" in line]
    assert joins and not any("__v" in j and ("__lo" in j or "__hi" in j) for j in joins)  # no range is a condition of a join


def test_grouped_event_parses_each_payload_once(spark):
    text = '{"id":"","slug":"s","description":"d","markets":[{"question":"Will it be 3°C on May?","outcomePrices":"[\\"0.2\\"]","clobTokenIds":["t"],"conditionId":"c"}]}'
    df = spark.createDataFrame([(text,), ("{}",), (None,), ('{"markets":[{"groupItemTitle":"x"}]}',)], "payload string")
    out = df.select(P.grouped_event(F.col("payload")).alias("g")).select("g.id", "g.condition_id", F.col("g.outcomes.label").alias("labels"), F.size("g.outcomes").alias("n"), "g.error")
    assert [tuple(r) for r in out.collect()] == [
        ("s", "c", ["3°C"], 1, None), (None, None, None, None, "missing_component_markets"), (None, None, None, None, "missing_component_markets"),
        (None, None, ["x"], 1, "malformed_component_market"),
    ]
    assert plan_of(out).count("StructField(slug") <= 1


@pytest.mark.parametrize("half", [2, 7])
def test_landed_files_grow_with_the_tables(spark, sf, monkeypatch, half):
    asked = []
    monkeypatch.setattr(q_stream, "source_bytes", lambda rows: 2 * half * q_stream.FILE_BYTES)
    monkeypatch.setattr(q_stream.J, "read_files", lambda spark, path, schema, files_per_batch: asked.append((spark.read.parquet(path), files_per_batch)))
    q_stream.landed(spark, sf, spark.range(1000))
    ((rows, batch),) = asked
    assert rows.count() == 1000 and len(rows.inputFiles()) == 2 * half and batch == half


def test_trade_report_makes_its_trades_once(spark, sf):
    trades = roles.trades(spark, sf)
    out = R.trade_report(trades, {"all": [], "horizon": ["decision_horizon"], "city": ["city"]})
    assert "lineitem" not in plan_of(out) and "l_orderkey" not in plan_of(out)
    whole = out.where("level = 'all'").first()
    assert whole["trades"] == trades.count()
    assert whole["median_edge"] == pytest.approx(trades.select(F.median("edge")).first()[0])
