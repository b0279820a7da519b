"""Keyed stream results: restarts, replays, missing epochs, late rows, the spread sketch."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.operators.merge import path_exists
from skyledger.session import scratch_path
from skyledger.streaming import jobs as J
from skyledger.streaming import keyed as K

TICKS = "position string, ts timestamp, seq long, price double"


def at(minutes):
    return dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=minutes)


def land(spark, path, rows, schema):
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.mode("append").parquet(path)
    return J.read_files(spark, path, df.schema)


def sums(spark, path, fold_every=3):
    return K.KeyedTable(spark, path, ["k"], [F.sum("n").alias("n")], fold_every)


def as_map(df, value="n"):
    return {r["k"]: r[value] for r in df.collect()}


def test_epochs_fold_and_replay(spark):
    table = sums(spark, scratch_path(spark, "keyed"))
    assert table.read() is None
    for epoch in range(8):
        rows = spark.createDataFrame([("a", 1), (f"e{epoch}", epoch)], "k string, n long")
        table.write(rows, epoch)
        if epoch in (2, 5):
            table.write(rows, epoch)  # a replay right behind a fold
    want = {"a": 8} | {f"e{i}": i for i in range(8)}
    assert as_map(table.read()) == want
    assert as_map(table.read(4)) == {"a": 4} | {f"e{i}": i for i in range(4)}
    assert K.numbered(spark, f"{table.path}/folds", "upto") == {2, 5}
    assert K.numbered(spark, f"{table.path}/epochs", "epoch") == {3, 4, 5, 6, 7}  # what the older fold holds is gone


def test_missing_and_foreign_epochs_are_refused(spark):
    table = sums(spark, scratch_path(spark, "keyed"))
    one = spark.createDataFrame([("a", 1)], "k string, n long")
    with pytest.raises(ValueError, match="epoch 0 is missing"):
        table.write(one, 1)
    for epoch in (0, 1):
        table.write(one, epoch)
    K.removed(spark, f"{table.path}/epochs/epoch=0/_SUCCESS")  # as if it had not ended
    with pytest.raises(ValueError, match="epoch 0 is missing"):
        table.write(one, 2)
    other = sums(spark, scratch_path(spark, "keyed"))
    for epoch in (0, 1):
        other.write(one, epoch)
    with pytest.raises(ValueError, match="not the results of this checkpoint"):
        other.write(one, 0)


def test_stop_states_change_only_for_touched_positions(spark):
    landing, path = scratch_path(spark, "ticks"), scratch_path(spark, "stops")
    first = [("a", at(0), 1, 10.0), ("a", at(1), 2, 12.0), ("b", at(0), 3, 10.0), ("c", at(0), 4, 5.0), ("c", at(1), 5, 3.9)]
    table = J.stop_alerts(land(spark, landing, first, TICKS), "position", "ts", "price", "seq", path)
    second = [("a", at(2), 6, 9.6), ("c", at(2), 7, 1.0), ("d", at(2), 8, 7.0)]
    J.stop_alerts(land(spark, landing, second, TICKS), "position", "ts", "price", "seq", path)
    alerts = {r["position"]: (r["exit_reason"], r["exit_price"], r["high_water_mark"]) for r in spark.read.parquet(f"{path}/alerts").collect()}
    assert alerts == {"c": ("stop_loss", 3.9, 5.0), "a": ("trailing_stop", 9.6, 12.0)}
    assert {r["position"] for r in spark.read.parquet(f"{path}/epochs/epoch=1").collect()} == {"a", "d"}  # neither b nor the exited c
    states = {r["position"]: tuple(r["state"]) for r in table.read().collect()}
    assert states == {"a": (10.0, 12.0, True), "b": (10.0, 10.0, False), "c": (5.0, 5.0, True), "d": (7.0, 7.0, False)}
    K.removed(spark, f"{path}/epochs/epoch=0")
    with pytest.raises(Exception, match="epoch 0 is missing"):
        J.stop_alerts(land(spark, landing, [("b", at(3), 9, 1.0)], TICKS), "position", "ts", "price", "seq", path)


def test_latest_price_writes_the_batchs_keys_only(spark):
    landing, path = scratch_path(spark, "ticks"), scratch_path(spark, "latest")
    rows = [("a", at(5), 1, 1.0), ("b", at(1), 2, 2.0), ("c", at(1), 3, None)]
    J.latest_price(land(spark, landing, rows, TICKS), ["position"], "ts", "price", path, ["seq"])
    rows = [("a", at(3), 4, 9.0), ("b", at(1), 5, 3.0), ("b", at(9), 6, None)]
    table = J.latest_price(land(spark, landing, rows, TICKS), ["position"], "ts", "price", path, ["seq"])
    assert {r["position"]: r["latest"]["price"] for r in table.read().collect()} == {"a": 1.0, "b": 3.0}
    assert spark.read.parquet(f"{path}/epochs/epoch=1").count() == 2
    assert not path_exists(spark, f"{path}/epochs/epoch=2")


def test_two_runs_equal_one(spark):
    rows = [(f"k{i % 3}", at(i), i, float(i)) for i in range(30)]
    results = []
    for parts in ([rows], [rows[:11], rows[11:]]):
        landing, path = scratch_path(spark, "ticks"), scratch_path(spark, "summary")
        for part in parts:
            table = J.running_summary(
                land(spark, landing, part, TICKS), ["position"], [F.count("*").alias("n"), F.max("price").alias("top")], [F.sum("n").alias("n"), F.max("top").alias("top")], path
            )
        results.append(sorted(map(tuple, table.read().collect())))
    assert results[0] == results[1] == [("k0", 10, 27.0), ("k1", 10, 28.0), ("k2", 10, 29.0)]


def test_late_rows_only_count(spark):
    landing, path = scratch_path(spark, "log"), scratch_path(spark, "cycles")
    schema = "ts timestamp, reason string, raw_gap double"
    J.cycle_summary(land(spark, landing, [(at(0), "tradable", 0.1), (at(150), "x", 0.2)], schema), "ts", "1 hour", "90 minutes", path)
    # the clock stands at 150 minutes: windows that end at 60 are closed, those that end later are not
    rows = [(at(10), "tradable", 0.9), (at(70), "tradable", 0.3), (None, "tradable", 0.4)]
    table = J.cycle_summary(land(spark, landing, rows, schema), "ts", "1 hour", "90 minutes", path)
    got = {int((r["start"].replace(tzinfo=dt.UTC) if r["start"].tzinfo is None else r["start"]).timestamp() - at(0).timestamp()) // 60: tuple(r)[1:] for r in table.read().select(F.col("start"), "markets_evaluated", "tradable_count", "best_raw_gap", "late_rows").collect()}
    assert sorted(got.values()) == sorted([(1, 1, 0.1, 1), (1, 1, 0.3, 0), (1, 0, 0.2, 0)])


def test_sketch_medians_are_within_their_bound(spark):
    rng = np.random.default_rng(2)
    landing, path = scratch_path(spark, "log"), scratch_path(spark, "l2")
    spreads = np.concatenate([rng.lognormal(-3, 2, 700), -rng.lognormal(0, 1, 20), np.zeros(11)])
    rows = [(at(0), float(s), 1.0, "x" if i % 2 else "y") for i, s in enumerate(spreads)] + [(at(0), None, 3.0, "x"), (at(0), None, None, "z")]
    table = J.l2_windows(land(spark, landing, rows, "ts timestamp, spread double, bid_depth double, b string"), "ts", "1 day", "1 day", F.col("b"), path)
    got = {r["bucket"]: r for r in J.l2_summary(table.read()).collect()}
    for name, own in (("x", spreads[1::2]), ("y", spreads[::2])):
        median = np.sort(own)[len(own) // 2]
        assert abs(got[name]["median_spread"] - median) <= abs(median) * (2 ** (0.5 / J.SKETCH_PER_OCTAVE) - 1) * 1.000001
    assert got["x"]["count"] == 366 and got["x"]["mean_bid_depth"] == pytest.approx(368 / 366)
    assert got["z"]["median_spread"] is None and got["z"]["mean_bid_depth"] is None and got["z"]["count"] == 1
