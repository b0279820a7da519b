"""Structured Streaming jobs over append-only files: logs, roll-ups, de-duplication,
stops, alerts and live as-of prices.

Every job takes a streaming frame and returns a streaming frame or a started
query. State is bounded by watermarks or by the number of keys; checkpoints go
to the shared folder. Results by key are kept as epochs and folds (``keyed``): a batch writes only what it changes, and
a later run with the same path goes on where the last ended.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from skyledger.operators.quantiles import value_slice
from skyledger.streaming.keyed import KeyedTable, run_keyed


def read_files(spark: SparkSession, path: str, schema, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(query_writer, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; restarting goes on from the checkpoint."""
    q = query_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def checkpoint_of(path: str) -> str:
    """The checkpoint that belongs to an output: beside it, so that a later run goes on where the last ended."""
    return f"{path.rstrip('/')}.checkpoint"


def append_partitioned(stream: DataFrame, path: str, time: str) -> StreamingQuery:
    """Append records to a table partitioned by day; exactly once per record, over all runs with ``path``."""
    rows = stream.withColumn("dt", F.date_format(time, "yyyy-MM-dd"))
    writer = rows.writeStream.format("parquet").outputMode("append").partitionBy("dt").option("path", path)
    return run_available(writer, checkpoint_of(path))


def running_summary(stream: DataFrame, keys: Sequence[str], partial: Sequence[Column], merged: Sequence[Column], path: str) -> KeyedTable:
    """Counts and extremes per key, kept up to date over all runs with ``path``.

    A batch writes partial aggregates of its own keys only; ``merged`` puts partials of the same
    names together when the table is read.
    """
    table = KeyedTable(stream.sparkSession, path, keys, merged)
    run_keyed(stream, table, lambda batch, _: batch.groupBy(*keys).agg(*partial))
    return table


def windowed_sums(
    stream: DataFrame,
    time: str,
    interval: str,
    late: str,
    keys: Mapping[str, Column],
    partial: Mapping[str, Column],
    merged: Sequence[Column],
    path: str,
) -> KeyedTable:
    """Partial aggregates per tumbling window (``start``) and keys; rows of closed windows only count in ``late_rows``.

    A window is closed once its end lies ``late`` or more behind the latest time of the batches before, as
    a watermark has it. Rows without a time belong to no window. The clock is kept beside the windows by epoch,
    so a replayed batch sees the same one; a later run with ``path`` goes on with both.
    """
    clock = KeyedTable(stream.sparkSession, f"{path}/clock", ["clock"], [F.max("seen").alias("seen")])
    table = KeyedTable(stream.sparkSession, path, ["start", *keys], [*merged, F.sum("late_rows").alias("late_rows")])
    at = F.col(time).cast("timestamp")

    def step(batch: DataFrame, epoch: int) -> DataFrame:
        before = clock.read(epoch)
        seen = before.first()["seen"] if before is not None else None
        clock.write(batch.agg(F.unix_micros(F.max(at)).alias("seen")).select(F.lit("all").alias("clock"), "seen"), epoch)
        rows = batch.where(at.isNotNull()).withColumn("__w", F.window(at, interval))
        closed = F.col("__w.end") <= F.timestamp_micros(F.lit(seen)) - F.expr(f"INTERVAL {late}") if seen is not None else F.lit(False)
        sums = rows.groupBy(F.col("__w.start").alias("start"), *[k.alias(n) for n, k in keys.items()], closed.alias("__late")).agg(
            *[c.alias(n) for n, c in partial.items()], F.count("*").alias("__n")
        )
        timely = [F.when(~F.col("__late"), F.col(n)).alias(n) for n in partial]
        return sums.select("start", *keys, *timely, F.when(F.col("__late"), F.col("__n")).otherwise(0).alias("late_rows"))

    run_keyed(stream, table, step)
    return table


def cycle_summary(stream: DataFrame, time: str, interval: str, late: str, path: str, keys: Sequence[str] = ()) -> KeyedTable:
    """Per-cycle counts in tumbling windows; rows later than ``late`` are dropped and counted."""
    partial = {
        "markets_evaluated": F.count("*"),
        "tradable_count": F.count(F.when(F.col("reason") == "tradable", 1)),
        "best_raw_gap": F.max("raw_gap"),
    }
    total = lambda n: F.coalesce(F.sum(n), F.lit(0)).alias(n)
    merged = [total("markets_evaluated"), total("tradable_count"), F.max("best_raw_gap").alias("best_raw_gap")]
    return windowed_sums(stream, time, interval, late, {k: F.col(k) for k in keys}, partial, merged, path)


def first_per_key(stream: DataFrame, keys: Sequence[str], time: str, late: str) -> DataFrame:
    """Drop repeated keys that arrive within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def stop_alerts(stream: DataFrame, position: str, time: str, price: str, sequence: str, path: str) -> KeyedTable:
    """First stop per position, with entry, peak and exit kept between batches.

    The first tick of a position is its entry. An epoch writes the state of the positions that its ticks change;
    untouched and exited ones are not written again. Each batch runs the sliced stop scan, so no task holds the ticks
    of one busy position. Alerts go to ``path/alerts``; running again goes on from the checkpoint, and an epoch
    without the states before it is refused. Ticks count in the order of their batches.
    """
    from skyledger.operators.asof import stop_scan

    spark = stream.sparkSession
    state = KeyedTable(spark, path, [position], [F.max_by("state", "epoch").alias("state"), F.max("epoch").alias("epoch")])

    def step(batch: DataFrame, epoch: int) -> DataFrame:
        seen = batch.groupBy(position).agg(F.min_by(price, F.struct(time, sequence)).alias("__first"), F.max(price).alias("__high"))
        known = state.read(epoch)
        if known is None:
            known = spark.createDataFrame([], f"{position} string, state struct<entry:double,peak:double,exited:boolean>, epoch long")
        current = seen.join(known, position, "left").where(~F.coalesce("state.exited", F.lit(False))).select(
            position,
            F.coalesce("state.entry", "__first").alias("entry"),
            F.coalesce("state.peak", "state.entry", "__first").alias("opening_peak"),
            "__high",
        )
        live = batch.join(current.select(position, "entry", "opening_peak"), position)
        alerts = stop_scan(live, [position], time, price, "entry", 0.20, [sequence], opening_peak="opening_peak")
        alerts.write.mode("overwrite").parquet(f"{path}/alerts/epoch={epoch}")
        fired = spark.read.schema(alerts.schema).parquet(f"{path}/alerts/epoch={epoch}").select(position, F.lit(True).alias("__now"))
        new = F.struct(
            F.col("entry").cast("double").alias("entry"),
            F.greatest("opening_peak", "__high").cast("double").alias("peak"),
            F.coalesce("__now", F.lit(False)).alias("exited"),
        )
        return current.join(fired, position, "left").select(position, new.alias("state"), F.lit(epoch).cast("long").alias("epoch"))

    run_keyed(stream, state, step)
    return state


def watch_matches(stream: DataFrame, rules: DataFrame, keys: Sequence[str], ask: str = "best_ask", threshold: str = "threshold") -> DataFrame:
    """Rows whose ask reaches a rule's threshold: stream joined with the rule table."""
    return stream.join(rules, list(keys)).where(F.col(ask) <= F.col(threshold)).withColumn("gap", F.col(threshold) - F.col(ask))


def freshness_flags(stream: DataFrame, generated: str, received: str, max_minutes: float) -> DataFrame:
    """Flag rows that were already old when they were received."""
    age = (F.unix_micros(received) - F.unix_micros(generated)) / F.lit(60e6)
    return stream.withColumn("age_minutes", age).withColumn("fresh", F.col("age_minutes") <= max_minutes)


def latest_price(stream: DataFrame, keys: Sequence[str], time: str, price: str, path: str, sequence: Sequence[str] = ()) -> KeyedTable:
    """Latest price per key over all runs with ``path``; a batch writes its own keys only.

    Rows without a price don't count. Of equal times the highest ``sequence`` wins, then the highest price.
    """
    newest = F.max(F.struct(time, *sequence, price)).alias("latest")
    table = KeyedTable(stream.sparkSession, path, keys, [F.max("latest").alias("latest")])
    run_keyed(stream, table, lambda batch, _: batch.where(F.col(price).isNotNull()).groupBy(*keys).agg(newest))
    return table


#: Slices of the quantile sketch per doubling of a value: a quantile is off by at most 0.28 % of itself.
SKETCH_PER_OCTAVE = 128


def slice_value(part: Column, per_octave: int = SKETCH_PER_OCTAVE) -> Column:
    """The middle (on a log scale) of a slice of ``value_slice``."""
    size = F.pow(F.lit(2.0), (F.abs(part) - 0.5) / per_octave - 1100.0)
    return F.when(part == 0, F.lit(0.0)).when(part > 0, size).otherwise(-size)


def l2_windows(stream: DataFrame, time: str, interval: str, late: str, bucket: Column, path: str) -> KeyedTable:
    """Depths, narrow spreads and a sketch of the spreads per window and settlement bucket; late rows are dropped and counted.

    The sketch counts spreads by slices of fixed relative width, so partial sketches add up exactly.
    """
    partial = {
        "count": F.count("*"),
        "bid": F.sum("bid_depth"),
        "bids": F.count("bid_depth"),
        "narrow": F.count(F.when(F.col("spread") < 0.10, 1)),
    }
    keys = {"bucket": bucket, "part": value_slice(F.col("spread").cast("double"), SKETCH_PER_OCTAVE)}
    return windowed_sums(stream, time, interval, late, keys, partial, [F.sum(n).alias(n) for n in partial], path)


def l2_summary(parts: DataFrame) -> DataFrame:
    """Rows of ``l2_windows`` per window and bucket, with the upper median of the spreads."""
    own = ["start", "bucket"]
    upto = Window.partitionBy(*own).orderBy("part")
    counted = F.when(F.col("part").isNotNull(), F.col("count"))
    ranked = parts.withColumn("__upto", F.sum(counted).over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ranked = ranked.withColumn("__total", F.sum(counted).over(Window.partitionBy(*own)))
    middle = F.when(F.col("part").isNotNull() & (F.col("__upto") > F.floor(F.col("__total") / 2)), F.col("part"))
    out = ranked.groupBy(*own).agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("count"),
        (F.sum("bid") / F.sum("bids")).alias("mean_bid_depth"),
        (F.sum("narrow") * 100 / F.sum("count")).alias("tradeable_pct"),
        F.min(middle).alias("__part"),
        F.sum("late_rows").alias("late_rows"),
    )
    return out.withColumn("median_spread", slice_value(F.col("__part"))).drop("__part")


def per_batch(stream: DataFrame, build: Callable[[DataFrame], DataFrame], path: str) -> StreamingQuery:
    """Run a batch operator on every micro-batch and append its result by epoch, a
    replayed epoch replacing its own output. The checkpoint belongs to ``path``: a later run goes on with
    the epochs after the last."""

    def write(batch: DataFrame, epoch: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return run_available(stream.writeStream.foreachBatch(write), checkpoint_of(path))


def live_panel(stream: DataFrame, ticks: DataFrame, keys: Sequence[str], path: str, **options) -> StreamingQuery:
    """Price decisions as they arrive against the tick table by the as-of join."""
    from skyledger.operators.asof import price_panel

    return per_batch(stream, lambda batch: price_panel(batch, ticks, keys, **options), path)

