"""One day of one key over several tasks: as-of joins and running stops against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skyledger.operators import asof as A

START = dt.datetime(2024, 1, 1)


def ticks(n, rng):
    """One busy key inside one day with ties in time, a quiet one over a week, one without a name."""
    rows = [("hot", START + dt.timedelta(seconds=rng.randint(0, 80_000)), i, rng.choice([None, *map(float, range(50, 60))])) for i in range(n)]
    rows += [("cold", START + dt.timedelta(hours=rng.randint(0, 160)), i, 1.0 + i) for i in range(40)]
    return rows + [(None, START + dt.timedelta(seconds=i), i, float(i)) for i in range(5)]


@pytest.fixture(scope="module")
def busy(spark):
    rows = ticks(4000, random.Random(5))
    return rows, spark.createDataFrame(rows, "k string, ts timestamp, seq long, price double")


def test_a_busy_day_is_cut_in_order(spark, busy):
    rows, df = busy
    sliced = df.withColumn("__slice", A.time_slice(F.col("ts"), 86_400)).withColumn("__at", F.col("ts"))
    (cut,) = A.cut_hot_slices([sliced], ["k"], 300)
    parts = cut.groupBy("k", "__slice").agg(F.min("ts").alias("low"), F.max("ts").alias("high"), F.count("*").alias("n")).where("k = 'hot'").orderBy("__slice").collect()
    assert len(parts) > 20 and max(p["n"] for p in parts) < 400
    assert all(a["high"] < b["low"] for a, b in zip(parts, parts[1:]))
    assert cut.count() == len(rows)
    (same,) = A.cut_hot_slices([sliced], ["k"], 10**9)
    assert same.schema["__slice"].dataType.simpleString() == "bigint"  # too small to hold such a slice: left alone


@pytest.mark.parametrize("slice_rows", [300, 10**9])
def test_asof_join_of_a_busy_day(spark, busy, slice_rows):
    rows, df = busy
    rng = random.Random(6)
    asked = [(i, rng.choice(["hot", "hot", "cold", "new"]), START + dt.timedelta(seconds=rng.randint(-100, 90_000))) for i in range(1500)]
    decisions = spark.createDataFrame(asked, "id int, k string, at timestamp")
    out = A.asof_join(decisions, df, ["k"], "at", "ts", ["price", "seq"], "seq", slice_rows=slice_rows)
    got = {r["id"]: (r["price"], r["seq"]) for r in out.collect()}
    by_key = {k: sorted(((t, s, p) for key, t, s, p in rows if key == k), key=lambda x: x[:2]) for k in ("hot", "cold", "new")}
    for i, k, at in asked:
        before = [(p, s) for t, s, p in by_key[k] if t <= at]
        assert got[i] == (before[-1] if before else (None, None))


@pytest.mark.parametrize("slice_rows", [300, 10**9])
def test_running_stops_of_a_busy_day(spark, busy, slice_rows):
    rows, df = busy
    priced = df.where("price IS NOT NULL AND k IS NOT NULL").withColumn("entry", F.lit(58.0))
    out = A.running_max(priced, ["k"], "ts", "price", "peak", ["seq"], slice_rows=slice_rows)
    got = {(r["k"], r["seq"]): r["peak"] for r in out.collect()}
    seen = {}
    for k, _, s, p in sorted((r for r in rows if r[0] and r[3] is not None), key=lambda r: (r[0], r[1], r[2])):
        seen[k] = max(seen.get(k, p), p)
        assert got[k, s] == seen[k]
    stops = {r["k"]: r["exit_reason"] for r in A.stop_scan(priced, ["k"], "ts", "price", "entry", 0.1, ["seq"], slice_rows=slice_rows).collect()}
    assert stops["hot"] == "stop_loss"


@pytest.mark.parametrize("slice_rows", [300, 10**9])
def test_previous_rows_of_a_busy_day(spark, busy, slice_rows):
    from skyledger.operators.windows import with_previous

    rows, df = busy
    out = with_previous(df.where("k IS NOT NULL AND price IS NOT NULL"), ["k"], "ts", "price", "before", ["seq"], slice_rows=slice_rows)
    got = {(r["k"], r["seq"]): r["before"] for r in out.collect()}
    last = {}
    for k, _, s, p in sorted((r for r in rows if r[0] and r[3] is not None), key=lambda r: (r[0], r[1], r[2])):
        assert got[k, s] == last.get(k)
        last[k] = p
