"""Gaussian post-processing models fitted by distributed aggregation.

A least-squares fit needs only sums of products, so one aggregate over the data
gives a fit of any size, and a table of such sums per time block gives every
expanding fit of a back-test at once. Fitted models score as column expressions.
Tree and logistic models use MLlib.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.functions.numeric import from_celsius, present, array_mean, array_std, to_celsius
from skyledger.operators.boosting import bin_limits, fit_classifier, fit_regressor
from skyledger.operators.expanding import arrow_rows, expanding_gaussian, solve
from skyledger.operators.isotonic import apply_isotonic, fit_isotonic  # noqa: F401
from skyledger.operators.nested import fit_nested
from skyledger.session import written

MIN_STD = 0.5
# Range of residuals that scale models learn from.
RESIDUAL_RANGE = (0.25, 12.0)


# --- linear fits --------------------------------------------------------------------


@dataclass
class LinearFit:
    """Coefficients over named feature expressions; scores inside the JVM.

    A missing feature counts as its fitted median, in the fit and when scoring.
    """

    features: list[str]
    coefficients: list[float]
    intercept: float
    medians: dict[str, float] = field(default_factory=dict)

    def column(self) -> Column:
        terms = [F.lit(float(c)) * filled(f, self.medians) for f, c in zip(self.features, self.coefficients)]
        return reduce(lambda a, b: a + b, terms, F.lit(float(self.intercept)))


@dataclass
class GaussianFit:
    """Mean and spread models; ``log_variance`` fits the logarithm of the variance."""

    mean: LinearFit
    spread: LinearFit
    log_variance: bool = False

    def std(self) -> Column:
        raw = self.spread.column()
        if self.log_variance:
            return F.sqrt(F.greatest(F.exp(raw), F.lit(MIN_STD**2)))
        return F.greatest(raw, F.lit(MIN_STD))

    def score(self, df: DataFrame, mean: str = "pred_mean", std: str = "pred_std") -> DataFrame:
        return df.withColumn(mean, self.mean.column()).withColumn(std, self.std())


def filled(feature: str, medians: Mapping[str, float]) -> Column:
    """A feature as a number, its median where it is missing (null or NaN)."""
    value = F.col(feature).cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(medians[feature])).otherwise(value) if feature in medians else value


def fitted_medians(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Median of every feature (0 where there is no value), one row a feature on the driver."""
    from skyledger.operators.features import feature_medians

    if not features:
        return {}
    value = {f: F.col(f).cast("double") for f in features}
    present_only = df.select(*[F.when(~F.isnan(value[f]), value[f]).alias(f) for f in features])
    return {r["feature"]: float(r["median"]) for r in feature_medians(present_only, features).collect()}


#: Tasks that merge the sums of all others; the driver merges theirs.
MERGERS = 16


def merged_sums(parts: Iterable[tuple[float, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray] | None:
    """Weight, means and centred products of several sets of rows as those of their union."""
    out = None
    for weight, means, inner in parts:
        if out is None:
            out = weight, means, inner
            continue
        total, gap = out[0] + weight, means - out[1]
        share = weight / total if total else 0.0
        out = total, out[1] + gap * share, out[2] + inner + np.outer(gap, gap) * out[0] * share
    return out


def centred_sums(df: DataFrame, x: Sequence[Column], y: Column, weight: Column) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums of weighted products of the centred (x..., y), their means and the weight sum, in one pass.

    Each task keeps its own means and centred products; they are merged by a few tasks, then by the driver, which
    gets as many numbers as a fit has products.
    """
    columns = [*x, y]
    k = len(columns)
    rows = df.select(weight.cast("double").alias("w"), *[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    schema = "part int, sums array<double>"

    def flat(found) -> list[float]:
        return [found[0], *found[1], *found[2].ravel()]

    def parsed(sums) -> tuple[float, np.ndarray, np.ndarray]:
        values = np.asarray(sums)
        return values[0], values[1 : k + 1], values[k + 1 :].reshape(k, k)

    def of_rows(batches):
        from pyspark import TaskContext

        def each():
            for batch in batches:
                w = batch["w"].to_numpy(zero_copy_only=False)
                total = w.sum()
                if total:
                    z = np.column_stack([batch[f"c{i}"].to_numpy(zero_copy_only=False) for i in range(k)])
                    means = w @ z / total
                    z = z - means
                    yield float(total), means, (z * w[:, None]).T @ z

        found = merged_sums(each())
        if found:
            yield from arrow_rows(schema, part=[TaskContext.get().partitionId() % MERGERS], sums=[flat(found)]).to_batches()

    def of_parts(table):
        found = merged_sums(map(parsed, table["sums"].to_pylist()))
        return arrow_rows(schema, part=[table["part"][0].as_py()], sums=[flat(found)])

    parts = rows.mapInArrow(of_rows, schema).groupBy("part").applyInArrow(of_parts, schema).collect()
    found = merged_sums(parsed(r["sums"]) for r in sorted(parts))
    return (found[2], found[1], found[0]) if found else (np.zeros((k, k)), np.zeros(k), 0.0)


def fit_linear(
    df: DataFrame, features: Sequence[str], y: str | Column, weight: str | None = None, ridge: float = 0.0, medians: Mapping[str, float] | None = None
) -> LinearFit:
    """Ordinary or ridge least squares (penalty on raw coefficients, none on the intercept).

    One pass over the rows at every width. Missing features (null or NaN) count as their median, which the fit keeps
    for scoring whether or not these rows have gaps; rows without a target or weight are left out. ``medians`` are those
    of the same rows where they are known.
    """
    target = (F.col(y) if isinstance(y, str) else y).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    usable = df.where(target.isNotNull() & ~F.isnan(target) & w.isNotNull())
    medians = fitted_medians(usable, features) if medians is None else dict(medians)
    sums, means, _ = centred_sums(usable, [filled(f, medians) for f in features], target, w)
    beta = solve(sums[:-1, :-1], sums[:-1, -1], ridge)
    return LinearFit(list(features), [float(b) for b in beta], float(means[-1] - means[:-1] @ beta), medians)


def fit_gaussian(
    df: DataFrame,
    features: Sequence[str],
    y: str,
    weight: str | None = None,
    ridge: float = 0.0,
    std_ridge: float | None = None,
    log_variance: bool = False,
) -> GaussianFit:
    """Heteroscedastic Gaussian regression: a mean fit, then a fit of the absolute
    residual (or of the log squared residual).

    Without features the log-variance form keeps the root mean square residual.
    """
    # medians and both fits read the rows: one narrow copy instead of three runs of what makes them
    df = written(df.select(*dict.fromkeys([*features, y, *([weight] if weight else [])])), "fit-rows")
    mean = fit_linear(df, features, y, weight, ridge)
    residual = F.col(y).cast("double") - mean.column()
    if log_variance and not features:
        square = fit_linear(df, features, residual * residual, weight)
        return GaussianFit(mean, LinearFit([], [], math.log(max(square.intercept, 1e-300))), True)
    target = F.log(F.greatest(residual * residual, F.lit(1e-4))) if log_variance else F.abs(residual)
    spread = fit_linear(df, features, target, weight, ridge if std_ridge is None else std_ridge, mean.medians)
    return GaussianFit(mean, spread, log_variance)


def polynomial(df: DataFrame, features: Sequence[str], scale: bool = False) -> tuple[DataFrame, list[str]]:
    """Add all second-degree terms; ``scale`` standardizes the inputs first."""
    base = list(features)
    if scale:
        stats = df.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(base)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(base)]).first()
        scaled = {f"z_{f}": (F.col(f) - float(stats[f"m{i}"])) / float(stats[f"s{i}"] or 1.0) for i, f in enumerate(base)}
        df, base = df.withColumns(scaled), list(scaled)
    terms = {f"{a}__x__{b}": F.col(a) * F.col(b) for i, a in enumerate(base) for b in base[i:]}
    return df.withColumns(terms), [*base, *terms]


def fit_polynomial(df: DataFrame, features: Sequence[str], y: str, scale: bool = False) -> tuple[DataFrame, GaussianFit]:
    """Second-degree Gaussian regression; the scaled form has a plain spread fit.

    Scale, medians and both fits read ``df``, up to five times: a frame that costs more to make than to read is written first.
    """
    wide, names = polynomial(df, features, scale)
    mean = fit_linear(wide, names, y)
    residual = F.abs(F.col(y) - mean.column())
    spread = fit_linear(wide, list(features) if scale else names, residual)
    return wide, GaussianFit(mean, spread)


# --- raw and blended baselines ---------------------------------------------------------


def raw_best(df: DataFrame, feature: str) -> DataFrame:
    return df.withColumn("pred_mean", F.col(feature)).withColumn("pred_std", F.lit(2.0))


def raw_average(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean of the available models, their sample deviation at least 0.5 (2 for one)."""
    v = df.withColumn("__v", present([F.col(f).cast("double") for f in features]))
    std = F.greatest(F.coalesce(array_std(F.col("__v"), 1), F.lit(2.0)), F.lit(MIN_STD))
    return v.withColumn("pred_mean", array_mean(F.col("__v"))).withColumn("pred_std", std).drop("__v")


def blend(df: DataFrame, first: Sequence[str], second: Sequence[str], y: str, learned: bool = True) -> DataFrame:
    """Blend of two feature families; their disagreement is the spread."""
    columns = [*first, *second]
    mean_of = lambda cols: array_mean(present([F.col(c).cast("double") for c in cols]))
    mean = fit_linear(df, columns, y).column() if learned else mean_of(columns)
    spread = F.abs(mean_of(first) - mean_of(second))
    return df.withColumn("pred_mean", mean).withColumn("pred_std", F.greatest(spread, F.lit(MIN_STD)))


def neighbor_ridge(df: DataFrame, features: Sequence[str], y: str, neighbor: str, spread: str | None, alpha: float = 1.0) -> DataFrame:
    """Ridge on the features and neighbour columns; the neighbour spread is the std."""
    columns = [*features, neighbor, *([spread] if spread else [])]
    filled = df.fillna(0.0, subset=columns)
    std = F.greatest(F.col(spread), F.lit(MIN_STD)) if spread else F.lit(1.0)
    return filled.withColumn("pred_mean", fit_linear(filled, columns, y, ridge=alpha).column()).withColumn("pred_std", std)


def with_pretrained(df: DataFrame, fit: GaussianFit, unit: str, primary: str, mode: str = "full") -> DataFrame:
    """Append the predictions of a model fitted in Celsius, in market units, and their
    difference from the primary forecast. Inputs are the model's Celsius features."""
    u = F.col(unit)
    scored = fit.score(df, "__mean_c", "__std_c")
    mean = from_celsius(F.col("__mean_c"), u)
    std = F.greatest(from_celsius(F.col("__std_c"), u, scale=True), F.lit(0.1))
    out = scored.withColumn("weather_pretrain_mean", mean).withColumn("weather_pretrain_std", std)
    out = out.withColumn("weather_pretrain_delta", F.col("weather_pretrain_mean") - F.col(primary)).drop("__mean_c", "__std_c")
    return out if mode == "full" else out.drop("weather_pretrain_mean", "weather_pretrain_std")


# --- calibration --------------------------------------------------------------------------


def renormalize(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Scale a decision's probabilities to sum to one where they sum to more than 0.
    A decision holds its outcomes only, so the window is small."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn("__t", total).withColumn(
        value, F.when(F.col("__t") > 0, F.col(value) / F.col("__t")).otherwise(F.col(value))
    ).drop("__t")


def disagreement_calibrated(
    df: DataFrame,
    unit: str,
    source_range: str,
    blend_per_c: float = 0.0,
    max_blend: float = 0.0,
    mode: str = "absolute",
    base_scale: float = 1.0,
    disagreement_weight: float = 0.0,
    range_weight: float = 0.0,
    fallback_weight: float = 0.0,
    floor: float = 0.5,
    cap: float = 12.0,
    blend_variance: bool = True,
) -> DataFrame:
    """Blend a primary Gaussian with a fallback by their disagreement and widen it.

    Columns: primary_mean, primary_std, fallback_mean, fallback_std in market
    units; the source range and all parameters are in Celsius.
    """
    u = F.col(unit)
    out = df.withColumns(
        {
            "__pm": to_celsius(F.col("primary_mean"), u),
            "__ps": F.greatest(to_celsius(F.col("primary_std"), u, scale=True), F.lit(floor)),
            "__fm": to_celsius(F.col("fallback_mean"), u),
            "__fs": F.greatest(to_celsius(F.col("fallback_std"), u, scale=True), F.lit(floor)),
        }
    ).withColumn("__d", F.col("__pm") - F.col("__fm"))
    d = F.col("__d")
    signal = {
        "positive": F.greatest(d, F.lit(0.0)),
        "negative": F.greatest(-d, F.lit(0.0)),
        "absolute": F.abs(d),
    }.get(mode, F.lit(0.0))
    out = out.withColumn("blend_weight", F.least(F.greatest(blend_per_c * signal, F.lit(0.0)), F.lit(max_blend)))
    w = F.col("blend_weight")
    variance = (
        F.pow(F.col("__ps") * base_scale, F.lit(2.0))
        + disagreement_weight * d * d
        + range_weight * F.pow(F.col(source_range), F.lit(2.0))
        + fallback_weight * F.greatest(F.col("__fs") * F.col("__fs") - F.col("__ps") * F.col("__ps"), F.lit(0.0))
    )
    if blend_variance:
        variance = variance + w * (1.0 - w) * d * d
    std = F.least(F.greatest(F.sqrt(F.greatest(variance, F.lit(floor * floor))), F.lit(floor)), F.lit(cap))
    return (
        out.withColumn("pred_mean", from_celsius((1.0 - w) * F.col("__pm") + w * F.col("__fm"), u))
        .withColumn("pred_std", from_celsius(std, u, scale=True))
        .drop("__pm", "__ps", "__fm", "__fs", "__d")
    )


def tail_calibrated(
    df: DataFrame,
    unit: str,
    shift: float = 0.0,
    multiplier: float = 1.0,
    additive: float = 0.0,
    floor: float = 0.5,
    mean_weight: float = 0.0,
    std_mode: str = "primary",
    std_weight: float | None = None,
    std_threshold: float | None = None,
    sentinels: Column | None = None,
    min_sentinels: int | None = None,
) -> DataFrame:
    """Shift and scale a Gaussian; rows with a suspicious spread or stored zeros lean
    on the fallback (std mode primary, max, blend or fallback)."""
    u = F.col(unit)
    primary_std = F.greatest(to_celsius(F.col("primary_std"), u, scale=True), F.lit(0.1))
    fallback_std = F.greatest(to_celsius(F.col("fallback_std"), u, scale=True), F.lit(0.1))
    mean = to_celsius(F.col("primary_mean"), u) + shift
    std = F.greatest(primary_std * multiplier + additive, F.lit(floor))
    mask = F.lit(False)
    if std_threshold is not None:
        mask = mask | (primary_std < std_threshold)
    if min_sentinels is not None and sentinels is not None:
        mask = mask | (sentinels >= min_sentinels)
    if mean_weight > 0.0 or std_mode != "primary":
        w = min(max(mean_weight, 0.0), 1.0)
        mean = F.when(mask, (1.0 - w) * mean + w * to_celsius(F.col("fallback_mean"), u)).otherwise(mean)
        sw = w if std_weight is None else min(max(std_weight, 0.0), 1.0)
        replaced = {
            "max": F.greatest(std, fallback_std),
            "blend": (1.0 - sw) * std + sw * fallback_std,
            "fallback": fallback_std,
        }.get(std_mode, std)
        std = F.greatest(F.when(mask, replaced).otherwise(std), F.lit(floor))
    return df.withColumn("pred_mean", from_celsius(mean, u)).withColumn("pred_std", from_celsius(std, u, scale=True))


def gated_mixture(df: DataFrame, weight: str, unit: str, min_std: float = 0.1, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Moments of the two-Gaussian mixture a gate weight gives, in market units."""
    u = F.col(unit)
    w = F.least(F.greatest(F.col(weight), F.lit(low)), F.lit(high))
    pm, fm = to_celsius(F.col("primary_mean"), u), to_celsius(F.col("fallback_mean"), u)
    ps = F.greatest(to_celsius(F.col("primary_std"), u, scale=True), F.lit(min_std))
    fs = F.greatest(to_celsius(F.col("fallback_std"), u, scale=True), F.lit(min_std))
    out = df.withColumns({"__w": w, "__pm": pm, "__fm": fm, "__ps": ps, "__fs": fs})
    out = out.withColumn("__m", (1.0 - F.col("__w")) * F.col("__pm") + F.col("__w") * F.col("__fm"))
    var = (1.0 - F.col("__w")) * (F.col("__ps") ** 2 + (F.col("__pm") - F.col("__m")) ** 2) + F.col("__w") * (
        F.col("__fs") ** 2 + (F.col("__fm") - F.col("__m")) ** 2
    )
    std = F.greatest(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(min_std))
    return (
        out.withColumn("pred_mean", from_celsius(F.col("__m"), u))
        .withColumn("pred_std", from_celsius(std, u, scale=True))
        .drop("__w", "__pm", "__fm", "__ps", "__fs", "__m")
    )


# --- gates, boosted and stacked models (MLlib) ------------------------------------------------


def _assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="keep").transform(df)


def gate_rows(df: DataFrame, margin: float, weight_mode: str, floor: float, cap: float) -> DataFrame:
    """Rows a gate learns from, with ``__label`` (the fallback scores better) and their weight ``__w``."""
    regret = F.col("primary_crps") - F.col("fallback_crps")
    raw = {"absolute_regret": F.abs(regret), "fallback_regret": F.greatest(regret, F.lit(0.0))}.get(weight_mode)
    weight = F.lit(1.0) if raw is None else F.least(F.greatest(raw + floor, F.lit(floor)), F.lit(cap))
    label = (F.col("fallback_crps") + margin < F.col("primary_crps")).cast("double")
    return df.withColumns({"__label": label, "__w": weight}).where(F.col("__label").isNotNull())


def source_gate(
    df: DataFrame,
    features: Sequence[str],
    margin: float = 0.0,
    max_iter: int = 20,
    min_rows: int = 20,
    weight_mode: str = "uniform",
    floor: float = 0.05,
    cap: float = 20.0,
    score: DataFrame | None = None,
) -> DataFrame:
    """Probability that the fallback scores better, learned from both CRPS columns of ``df``; scores ``score`` or ``df``.

    Columns: primary_crps, fallback_crps (rows without either are not learned from). With too few rows or one class
    only, the weight is the share of rows the fallback wins. ``weight_mode`` ``absolute_regret`` or ``fallback_regret`` weighs rows
    by the difference of the scores, held inside ``floor`` and ``cap`` and divided by its mean.
    """
    rows = gate_rows(df, margin, weight_mode, floor, cap)
    target = df if score is None else score
    facts = rows.agg(F.count("*").alias("n"), F.avg("__label").alias("rate"), F.avg("__w").alias("w")).first()
    if facts["n"] < min_rows or facts["rate"] in (None, 0.0, 1.0):
        return target.withColumn("fallback_weight", F.lit(float(facts["rate"] or 0.0)))
    ready = rows.withColumn("__w", F.col("__w") / max(facts["w"], 1e-9))
    return fit_classifier(ready, features, "__label", "__w", max_iter, 3)(target, "fallback_weight")


def source_gates(
    df: DataFrame,
    features: Sequence[str],
    fold: str,
    ordinal: str,
    margin: float = 0.0,
    max_iter: int = 20,
    min_rows: int = 20,
    weight_mode: str = "uniform",
    floor: float = 0.05,
    cap: float = 20.0,
) -> DataFrame:
    """Each validation fold scored by the ``source_gate`` of the groups before it, other rows by that of all rows; adds fallback_weight.

    The gates' training rows are nested, so all gates are learned in common passes (``nested.fit_nested``) and the rows are scored
    in one. ``df`` is read several times. One row a fold reaches the driver.
    """
    folds = df.where(F.col(fold).isNotNull()).groupBy(fold).agg(F.min(ordinal).alias("start")).orderBy(fold).collect()
    # the gate of fold k learns from parts 0 to k, the last gate from all
    part = reduce(lambda a, b: a + b, [(F.col(ordinal) >= r["start"]).cast("int") for r in folds], F.lit(0))
    rows = gate_rows(df, margin, weight_mode, floor, cap).withColumn("__part", part)
    facts = {r["__part"]: r for r in rows.groupBy("__part").agg(F.count("*").alias("n"), F.sum("__label").alias("won")).collect()}
    gate, constant, learned = F.lit(len(folds)), F.lit(None).cast("double"), []
    for k, r in enumerate(folds):
        gate = F.when(F.col(fold) == r[fold], k).otherwise(gate)
    for k in range(len(folds) + 1):
        n, won = (sum(facts[p][x] for p in facts if p <= k) for x in ("n", "won"))
        if n < min_rows or won in (0.0, n):
            constant = F.when(gate == k, won / n if n else 0.0).otherwise(constant)
        else:
            learned.append(k)
    if not learned:
        return df.withColumn("fallback_weight", constant)
    model = F.lit(None).cast("int")
    for i, k in enumerate(learned):
        model = F.when(gate == k, i).otherwise(model)
    score = fit_nested(rows, features, "__label", "__w", "__part", learned, max_iter, 3)
    return df.withColumn("__learned", score(model)).withColumn("fallback_weight", F.coalesce(constant, "__learned")).drop("__learned")


def out_of_fold(df: DataFrame, fits: dict, fold: str, ordinal: str) -> DataFrame:
    """Add predictions for every validation fold by models fitted on earlier groups
    only; rows outside all folds take the models of all rows.

    ``fits`` maps a new column to ``fit(train)``, which returns a function that adds
    it to a frame. A fold's models score its rows together, so the parts are unioned
    once. One fit per model and fold is a distributed job; both are few.
    """

    def score(train: DataFrame, rows: DataFrame) -> DataFrame:
        for into, fit in fits.items():
            rows = fit(train)(rows, into)
        return rows

    starts = df.where(F.col(fold).isNotNull()).groupBy(fold).agg(F.min(ordinal).alias("start")).collect()
    parts = [score(df, df.where(F.col(fold).isNull()))]
    for r in sorted(starts, key=lambda r: r[0]):
        parts.append(score(df.where(F.col(ordinal) < r["start"]), df.where(F.col(fold) == r[0])))
    return reduce(DataFrame.unionByName, parts)


def boosted_gaussian(df: DataFrame, features: Sequence[str], y: str, group: Sequence[str], max_iter: int = 20, depth: int = 4, n_splits: int = 4) -> DataFrame:
    """Boosted mean and a boosted scale on clipped out-of-fold absolute residuals."""
    from skyledger.operators.folds import validation_folds

    # the groups' order and the folds read the rows too: one copy instead of two runs of what makes them
    ready = written(validation_folds(written(df, "boosted-rows"), group, n_splits), "boosted")
    limits = bin_limits(ready.where(F.col(y).isNotNull()), features)

    def fit(train: DataFrame):
        return fit_regressor(train, features, y, max_iter, depth)

    mean_model = fit_regressor(ready, features, y, max_iter, depth, limits)
    oof = out_of_fold(ready, {"__oof": fit}, "fold", "ordinal")
    residual = F.least(F.greatest(F.abs(F.col(y) - F.col("__oof")), F.lit(RESIDUAL_RANGE[0])), F.lit(RESIDUAL_RANGE[1]))
    # a residual without a target is none: least and greatest pass over nulls
    oof = oof.withColumn("__r", F.when(F.col(y).isNotNull(), residual))
    scale_model = fit_regressor(oof, features, "__r", max_iter, depth, limits)
    scored = scale_model(mean_model(ready, "pred_mean"), "pred_std")
    std = F.least(F.greatest(F.col("pred_std"), F.lit(RESIDUAL_RANGE[0])), F.lit(RESIDUAL_RANGE[1]))
    return scored.withColumn("pred_std", std).drop("fold", "ordinal")


# --- back-test ----------------------------------------------------------------------------------


def refit_block(ordinal: Column, min_train: int, step: int) -> Column:
    """0 for the first training part, then 1, 2, ... per ``step`` groups tested."""
    return F.when(ordinal < min_train, 0).otherwise(F.floor((ordinal - min_train) / step) + 1).cast("int")


def rolling_backtest(
    df: DataFrame,
    features: Sequence[str],
    y: str,
    group: Sequence[str],
    min_train: int,
    test_size: int = 1,
    retrain_stride: int = 1,
    ridge: float = 0.0,
) -> DataFrame:
    """Score every test row with the latest fit made before its fold.

    Folds test ``test_size`` groups; a fit is made every ``retrain_stride`` folds on
    all earlier groups. Adds ordinal, fold, refit, pred_mean and pred_std; rows of
    the first training part are left out. Missing features count as the median of what the fit has
    learned from; a table without test rows gives an empty result.
    """
    from skyledger.operators.folds import expanding_folds

    folded = expanding_folds(df, group, min_train, test_size)
    step = test_size * retrain_stride
    # Read by every pass, so written once; in order, so that a task meets few blocks and a large first block is many tasks.
    blocked = folded.withColumn("__block", refit_block(F.col("ordinal"), min_train, step))
    blocked = written(blocked.repartitionByRange("__block", "ordinal"), "folded")
    fits = expanding_gaussian(blocked, features, y, "__block", ridge)
    test = blocked.where(F.col("__block") > 0).withColumn("refit", F.col("__block") - 1)
    return fits.score(test).drop("__block")
