"""Forecast scores and distribution summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.operators.asof import last_value


def implied_distribution(
    ticks: DataFrame,
    market_keys: Sequence[str],
    label: str,
    price: str,
    time_column: str,
    sequence: Sequence[str] = (),
) -> DataFrame:
    """Last price of every outcome, scaled to sum to one where the sum is positive."""
    last = last_value(ticks, [*market_keys, label], price, time_column, sequence)
    total = F.sum(price).over(Window.partitionBy(*market_keys))
    return last.withColumn("prob", F.when(total > 0, F.col(price) / total).otherwise(F.col(price)))


def brier_rows(df: DataFrame, keys: Sequence[str], label: str, prob: str, winner: str) -> DataFrame:
    """Multi-class Brier per decision from long rows (mean over its labels)."""
    error = F.pow(F.col(prob) - F.when(F.col(label) == F.col(winner), 1.0).otherwise(0.0), F.lit(2.0))
    return df.groupBy(*keys).agg(F.avg(error).alias("brier"))


def calibration_error(df: DataFrame, prob: str, hit: str, keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins ``[start, end)``.

    A probability of exactly 1 falls into no bin but counts in the total.
    """
    p = F.col(prob)
    valid = df.where(p.isNotNull() & F.col(hit).isNotNull())
    per = valid.groupBy(*keys, F.when((p >= 0) & (p < 1), F.floor(p * bins)).alias("__bin")).agg(
        F.count("*").alias("__n"), F.avg(p).alias("__p"), F.avg(F.col(hit).cast("double")).alias("__y")
    )
    gap = F.when(F.col("__bin").isNotNull(), F.col("__n") * F.abs(F.col("__p") - F.col("__y")))
    return per.groupBy(*keys).agg(
        F.sum("__n").alias("n"), (F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("__n")).alias("calibration_error")
    )


def point_scores(df: DataFrame, mean: str, std: str, actual: str, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, negative log-likelihood and closed-form CRPS per group."""
    from skyledger.functions.numeric import gaussian_nll, with_gaussian_crps

    m, s, y = F.col(mean), F.col(std), F.col(actual)
    return with_gaussian_crps(df, mean, std, actual, "__crps").groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(y - m)).alias("mae"),
        F.sqrt(F.avg((y - m) * (y - m))).alias("rmse"),
        F.avg(gaussian_nll(m, s, y)).alias("nll"),
        F.avg("__crps").alias("crps"),
    )


def _evaluation(rows: DataFrame, keys: Sequence[str], means: dict, bins: int = 10) -> DataFrame:
    """Means of several row scores and the calibration error of ``__p`` against
    ``__hit``, from one pass: rows are first summed per key and probability bin."""
    p = F.col("__p")
    per = rows.groupBy(*keys, F.when((p >= 0) & (p < 1), F.floor(p * bins)).alias("__bin")).agg(
        F.count("*").alias("__n"),
        F.sum("__p").alias("__sp"),
        F.sum("__hit").alias("__sy"),
        *[F.sum(c).alias(f"__s_{n}") for n, c in means.items()],
    )
    gap = F.when(F.col("__bin").isNotNull(), F.abs(F.col("__sp") - F.col("__sy")))
    total = F.sum("__n")
    return per.groupBy(*keys).agg(
        total.alias("n"),
        *[(F.sum(f"__s_{n}") / total).alias(n) for n in means],
        (F.sum("__sy") / total).alias("direction_accuracy"),
        (F.coalesce(F.sum(gap), F.lit(0.0)) / total).alias("calibration_error"),
    )


def _with_top(rows: DataFrame, winner: str) -> DataFrame:
    from skyledger.operators import bins as B

    top = rows.withColumn("__top", B.top_outcome(F.col("__probs")))
    return top.withColumn("__hit", (F.col("__top.label") == F.col(winner)).cast("double")).withColumn("__p", F.col("__top.prob"))


def evaluate(df: DataFrame, mean: str, std: str, actual: str, unit: str, bins, winner: str, keys: Sequence[str] = ()) -> DataFrame:
    """Model evaluation roll-up on rows where everything is known: errors in market
    units and Celsius, Brier, direction accuracy and calibration error."""
    from skyledger.functions.numeric import to_celsius, with_gaussian_crps
    from skyledger.operators import bins as B

    m, s, y, u = F.col(mean), F.col(std), F.col(actual), F.col(unit)
    valid = df.where(m.isNotNull() & s.isNotNull() & y.isNotNull() & F.col(winner).isNotNull())
    scored = with_gaussian_crps(valid, mean, std, actual, "__crps")
    rows = _with_top(scored.withColumn("__probs", B.labeled(bins, B.normal_masses(bins, m, s))), winner)
    return _evaluation(
        rows,
        keys,
        {
            "mae_market_unit": F.abs(y - m),
            "mae_c": to_celsius(F.abs(y - m), u, scale=True),
            "crps_market_unit": F.col("__crps"),
            "crps_c": to_celsius(F.col("__crps"), u, scale=True),
            "brier": B.brier(F.col("__probs"), F.col(winner)),
        },
    )


def evaluate_samples(df: DataFrame, samples: str, actual: str, bins, winner: str, keys: Sequence[str] = ()) -> DataFrame:
    """The same roll-up for forecasts given as arrays of samples."""
    from skyledger.functions.numeric import array_mean, sample_crps
    from skyledger.operators import bins as B

    y = F.col(actual)
    rows = _with_top(df.withColumn("__probs", B.labeled(bins, B.sample_masses(bins, F.col(samples)))), winner)
    return _evaluation(
        rows,
        keys,
        {
            "mae": F.abs(array_mean(F.col(samples)) - y),
            "crps": sample_crps(F.col(samples), y),
            "brier": B.brier(F.col("__probs"), F.col(winner)),
        },
    )


def seed_summary(df: DataFrame, model: str, metrics: Sequence[str], min_trades: float, trades: str) -> DataFrame:
    """Mean and population deviation of every metric over seeds, and whether each
    seed had enough trades."""
    return df.groupBy(model).agg(
        F.count("*").alias("seeds"),
        *[F.avg(m).alias(f"{m}_mean") for m in metrics],
        *[F.stddev_pop(m).alias(f"{m}_std") for m in metrics],
        F.bool_and(F.col(trades) >= min_trades).alias("sample_adequacy_passed"),
    )


def oracle_comparison(df: DataFrame, first: str, second: str, weight: str, keys: Sequence[str] = ()) -> DataFrame:
    """Two forecasters row by row: best-of-both mean, how often the second wins,
    differences, and exact quantiles of the gate weight."""
    from skyledger.operators.quantiles import with_quantiles

    a, b = F.col(first), F.col(second)
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(F.least(a, b)).alias("oracle_mean"),
        F.avg((b < a).cast("double")).alias("second_better_rate"),
        F.avg(b - a).alias("mean_difference"),
        F.avg(F.abs(b - a)).alias("mean_abs_difference"),
        F.avg(F.when(F.col(weight) >= 0.5, 1.0).otherwise(0.0)).alias("weight_share_half"),
    )
    return with_quantiles(out, df, keys, weight, {"weight_p10": 0.1, "weight_p50": 0.5, "weight_p90": 0.9})


def expert_diagnostics(df: DataFrame, experts: Sequence[str], weights: Sequence[str], actual: str, scales: Sequence[str] = ()) -> DataFrame:
    """Error of every expert, of the best expert per row, gate entropy, how often the
    heaviest expert is the best, and quantiles of the mean predicted deviation."""
    from functools import reduce

    from skyledger.operators.quantiles import with_quantiles

    errors = [F.abs(F.col(e) - F.col(actual)) for e in experts]
    entropy = reduce(lambda a, b: a + b, [-F.col(w) * F.log(F.greatest(F.col(w), F.lit(1e-6))) for w in weights])
    best = F.array_position(F.array(*errors), F.least(*errors))
    heaviest = F.array_position(F.array(*[F.col(w) for w in weights]), F.greatest(*[F.col(w) for w in weights]))
    out = df.agg(
        F.count("*").alias("n"),
        *[F.avg(x).alias(f"{e}_mae") for e, x in zip(experts, errors)],
        F.avg(F.least(*errors)).alias("best_expert_mae"),
        F.avg(entropy).alias("gate_entropy"),
        F.avg((best == heaviest).cast("double")).alias("gate_match_rate"),
    )
    if not scales:
        return out
    mean_scale = reduce(lambda a, b: a + b, [F.col(s) for s in scales]) / len(scales)
    wanted = {"pred_std_p50": 0.5, "pred_std_p90": 0.9, "pred_std_p99": 0.99}
    return with_quantiles(out, df.withColumn("__scale", mean_scale), [], "__scale", wanted)


def dense_rank_score(df: DataFrame, name: str, lower: dict[str, float], higher: dict[str, float], into: str) -> DataFrame:
    """Weighted sum of dense ranks, lower or higher being better; absent columns skip.

    A leaderboard has one row per model, so one window over it is small.
    """
    score = F.lit(0.0)
    for column, weight in lower.items():
        if column in df.columns:
            score = score + F.dense_rank().over(Window.orderBy(F.asc(column))) * weight
    for column, weight in higher.items():
        if column in df.columns:
            score = score + F.dense_rank().over(Window.orderBy(F.desc(column))) * weight
    return df.withColumn(into, score)


# Weights of the research and the execution leaderboard scores.
RESEARCH_LOWER = {
    "avg_crps_mean": 0.25,
    "avg_brier_mean": 0.2,
    "calibration_gap_mean": 0.15,
    "mae_mean": 0.15,
    "rmse_mean": 0.05,
    "nll_mean": 0.05,
    "mae_std": 0.05,
}
RESEARCH_HIGHER = {"real_history_pnl_mean": 0.10}
EXECUTION_LOWER = {
    "calibration_gap_mean": 0.2,
    "avg_crps_mean": 0.1,
    "avg_brier_mean": 0.1,
    "mae_mean": 0.05,
    "rmse_mean": 0.05,
    "nll_mean": 0.05,
}
EXECUTION_HIGHER = {
    "real_history_pnl_mean": 0.35,
    "real_history_avg_edge_mean": 0.07,
    "real_history_hit_rate_mean": 0.03,
}


def score_leaderboard(df: DataFrame) -> DataFrame:
    return dense_rank_score(df, "model_name", RESEARCH_LOWER, RESEARCH_HIGHER, "champion_score")


def score_execution(df: DataFrame) -> DataFrame:
    """Execution score over adequately sampled models, over all where none is."""
    if "sample_adequacy_passed" in df.columns:
        passed = F.coalesce(F.col("sample_adequacy_passed"), F.lit(False))
        any_passed = df.agg(F.max(passed)).scalar()
        df = df.withColumn("__any", any_passed).where(passed | ~F.col("__any")).drop("__any")
    return dense_rank_score(df, "model_name", EXECUTION_LOWER, EXECUTION_HIGHER, "execution_candidate_score")


def first_by_score(df: DataFrame, score: str, name: str = "model_name") -> DataFrame:
    return df.orderBy(score, name).limit(1)


def beats(candidate: Sequence, baseline: Sequence):
    """Lexicographic comparison of metric tuples, missing counts as infinite."""
    inf = F.lit(float("inf"))
    left = F.struct(*[F.coalesce(c, inf).alias(f"m{i}") for i, c in enumerate(candidate)])
    right = F.struct(*[F.coalesce(c, inf).alias(f"m{i}") for i, c in enumerate(baseline)])
    return left < right


def guarded_choice(df: DataFrame, guard: str, target: str, tolerance: float, name: str) -> DataFrame:
    """Within a tolerance of the best guard metric, the row with the least target."""
    best = df.agg(F.min(guard)).scalar()
    return (
        df.withColumn("__best", best)
        .where(F.col(guard) <= F.col("__best") + tolerance)
        .orderBy(target, guard, name)
        .limit(1)
        .drop("__best")
    )
