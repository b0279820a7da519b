"""Stacked experts: out-of-fold predictions of a few models and three ways to combine them.

The linear experts of all folds and of all rows come from one set of running sums (``expanding``): fold k's fit is
refit k, the fit of all rows is the last refit. Only the boosted expert is fitted fold by fold, a distributed
job each.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.operators.boosting import bin_limits, fit_regressor
from skyledger.operators.expanding import ExpandingFits, degree_two_maps, expanding_gaussian
from skyledger.operators.folds import validation_folds
from skyledger.operators.models import RESIDUAL_RANGE, _assemble, filled, fit_linear, fitted_medians
from skyledger.session import written

EXPERTS = ("blend", "leadtime", "tree")
#: Below these counts of rows: a constant model, a constant scale, a constant gate.
LEAST_ROWS, LEAST_SCALE_ROWS, LEAST_GATE_ROWS = 40, 12, 20


def clipped(value: Column) -> Column:
    """Inside the range of residuals that scale models learn from."""
    return F.least(F.greatest(value, F.lit(RESIDUAL_RANGE[0])), F.lit(RESIDUAL_RANGE[1]))


def mean_of(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns) / len(columns)


def tree_expert(train: DataFrame, features: Sequence[str], y: str, max_iter: int) -> Callable[[DataFrame], DataFrame]:
    """Boosted mean and boosted scale of a training part; the result adds ``mean_tree`` and ``scale_tree``."""
    limits = bin_limits(train, features)
    mean = fit_regressor(train, features, y, max_iter, 4, limits)
    scale = fit_regressor(mean(train, "__m").withColumn("__r", clipped(F.abs(F.col(y) - F.col("__m")))), features, "__r", max_iter, 4, limits)

    def score(rows: DataFrame) -> DataFrame:
        out = scale(mean(rows, "mean_tree"), "scale_tree")
        return out.withColumn("scale_tree", clipped(F.col("scale_tree")))

    return score


def linear_scored(fits: dict[str, ExpandingFits], rows: DataFrame, refit: str) -> DataFrame:
    for name, fit in fits.items():
        rows = fit.score(rows, refit, f"mean_{name}", f"scale_{name}", RESIDUAL_RANGE)
    return rows


def gate_inputs(rows: DataFrame, names: Sequence[str], experts: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The gate's columns: features, the experts' means and scales, and how far they are apart."""
    means, scales = [F.col(f"mean_{e}") for e in experts], [F.col(f"scale_{e}") for e in experts]
    centre = mean_of(means)
    out = rows.withColumns(
        {
            "__spread": F.sqrt(mean_of([(m - centre) * (m - centre) for m in means])),
            "__range": F.greatest(*means) - F.least(*means) if len(means) > 1 else F.lit(0.0),
            "__scale": mean_of(scales),
        }
    )
    return out, [*names, *[f"mean_{e}" for e in experts], *[f"scale_{e}" for e in experts], "__spread", "__range", "__scale"]


def gate_weights(valid: DataFrame, rows: DataFrame, names: Sequence[str], y: str, experts: Sequence[str]) -> DataFrame:
    """``weight_e`` per expert by a logistic model of which expert is best; one expert alone where there is too little to learn."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import vector_to_array

    errors = [F.abs(F.col(y) - F.col(f"mean_{e}")) for e in experts]
    best = F.array_position(F.array(*errors), F.least(*errors) if len(errors) > 1 else errors[0]).cast("double") - 1
    learned, columns = gate_inputs(valid.withColumn("__best", best).where(F.col("__best") >= 0), names, experts)
    facts = learned.agg(F.count("*").alias("n"), F.min("__best").alias("low"), F.max("__best").alias("high")).first()
    if facts["n"] < LEAST_GATE_ROWS or facts["low"] == facts["high"]:
        return rows.withColumns({f"weight_{e}": F.lit(float(i == int(facts["low"] or 0))) for i, e in enumerate(experts)})
    scored, _ = gate_inputs(rows, names, experts)
    learned, scored = (_assemble(d, columns) for d in (learned, scored))
    scaler = StandardScaler(inputCol="__x", outputCol="__z", withMean=True).fit(learned)
    gate = LogisticRegression(featuresCol="__z", labelCol="__best", maxIter=100, family="multinomial", regParam=1.0 / facts["n"])
    out = gate.fit(scaler.transform(learned)).transform(scaler.transform(scored)).withColumn("__g", vector_to_array("probability"))
    out = out.withColumns({f"weight_{e}": F.coalesce(F.get("__g", F.lit(i)), F.lit(0.0)) for i, e in enumerate(experts)})
    return out.drop("__z", "__g", "rawPrediction", "probability", "prediction", "__spread", "__range", "__scale")


def stacked_gaussian(
    df: DataFrame,
    features: Sequence[str],
    lead_features: Sequence[str],
    y: str,
    group: Sequence[str],
    alpha: float = 1.0,
    max_iter: int = 20,
    n_splits: int = 4,
    experts: Sequence[str] = EXPERTS,
    combiner: str = "classifier_gate",
    weight: str | None = None,
    gate_features: Sequence[str] | None = None,
) -> DataFrame:
    """Experts with out-of-fold predictions, combined; adds pred_mean and pred_std, and mean_e, scale_e per expert.

    Experts: ``blend`` (ridge on all features), ``leadtime`` (ridge on the standardized lead features and their products),
    ``tree`` (boosted). Validation folds lie behind what their models have seen. Missing features count as their
    median. Combiners: ``classifier_gate`` (a logistic model of the best expert gives weight_e; moments of the mixture),
    ``linear_stacker`` (ridge on the out-of-fold means, one scale model of its residuals on ``gate_features``),
    ``fixed_average``. With fewer than 40 rows, without features or without a fold the result is the
    mean and deviation of the target; expert columns are null then.
    """
    features, lead_features = list(features), list(lead_features)
    gate_features = features if gate_features is None else list(gate_features)
    experts = [e for e in EXPERTS if e in experts]
    names = list(dict.fromkeys([*features, *lead_features, *gate_features]))
    target = F.col(y).cast("double")
    # folds, facts, medians and the ordered copy all read the rows
    folded = written(validation_folds(written(df, "stacked-rows"), group, n_splits), "stacked-folds")
    facts = folded.agg(
        F.count(target).alias("n"), F.avg(target).alias("mean"), F.stddev_pop(target).alias("std"),
        F.min(F.when(F.col("fold").isNotNull(), F.col("ordinal"))).alias("first"), F.max("fold").alias("last"),
    ).first()
    if not features or facts["n"] < LEAST_ROWS or facts["first"] is None:
        none = {f"{kind}_{e}": F.lit(None).cast("double") for e in experts for kind in ("mean", "scale")}
        constant = {"pred_mean": F.lit(float(facts["mean"] or 0.0)), "pred_std": F.lit(max(float(facts["std"] or 0.0), 0.5) if facts["n"] else 1.0)}
        return folded.drop("fold", "ordinal").withColumns(none | constant)

    # rows before the first fold are block 0, fold k is block k + 1, rows behind the last fold come last
    tail = int(facts["last"]) + 2
    block = F.when(F.col("fold").isNotNull(), F.col("fold") + 1).when(F.col("ordinal") < facts["first"], 0).otherwise(tail).cast("int")
    medians = fitted_medians(folded, names)
    column = {n: f"__f{i}" for i, n in enumerate(names)}
    ready = folded.withColumns({c: filled(n, medians) for n, c in column.items()} | {"__block": block})
    lead = [column[n] for n in lead_features]
    terms = {f"{a}x{b}": F.col(a) * F.col(b) for i, a in enumerate(lead) for b in lead[i:]}
    ready = written(ready.withColumns(terms).repartitionByRange("__block", "ordinal"), "stacked")
    last = int(ready.agg(F.max("__block")).first()[0])

    fits = {}
    if "blend" in experts:
        fits["blend"] = expanding_gaussian(ready, [column[n] for n in features], y, "__block", alpha, weight, RESIDUAL_RANGE, whole=True)
    if "leadtime" in experts:
        maps = degree_two_maps(ready, lead, "__block", whole=True)
        fits["leadtime"] = expanding_gaussian(ready, [*lead, *terms], y, "__block", alpha, weight, RESIDUAL_RANGE, lead, maps, whole=True)
    valid = linear_scored(fits, ready.where(F.col("fold").isNotNull()).withColumn("__refit", F.col("fold").cast("int")), "__refit")
    scored = linear_scored(fits, ready.withColumn("__refit", F.lit(last)), "__refit")
    if "tree" in experts:
        seen = ready.where(target.isNotNull())
        tree_features = [column[n] for n in features]
        parts = [tree_expert(seen.where(F.col("__block") <= k), tree_features, y, max_iter)(valid.where(F.col("fold") == k)) for k in range(int(facts["last"]) + 1)]
        valid = reduce(DataFrame.unionByName, parts)
        scored = tree_expert(seen, tree_features, y, max_iter)(scored)
    valid = written(valid.where(target.isNotNull()), "stacked-oof")

    means, scales = [F.col(f"mean_{e}") for e in experts], [F.col(f"scale_{e}") for e in experts]
    gate_columns = [column[n] for n in gate_features]
    if combiner == "classifier_gate":
        out = gate_weights(valid, scored, gate_columns, y, experts)
        weights = [F.col(f"weight_{e}") for e in experts]
        out = out.withColumn("pred_mean", reduce(lambda a, b: a + b, [w * m for w, m in zip(weights, means)]))
        second = reduce(lambda a, b: a + b, [w * (s * s + m * m) for w, m, s in zip(weights, means, scales)])
        out = out.withColumn("pred_std", F.sqrt(F.greatest(second - F.col("pred_mean") ** 2, F.lit(RESIDUAL_RANGE[0] ** 2))))
    elif combiner == "linear_stacker":
        stacker = fit_linear(valid, [f"mean_{e}" for e in experts], y, weight, alpha, medians={})
        residual = clipped(F.abs(target - stacker.column()))
        scale = fit_linear(valid, gate_columns if valid.count() >= LEAST_SCALE_ROWS else [], residual, weight, alpha, medians={})
        out = scored.withColumns({"pred_mean": stacker.column(), "pred_std": clipped(scale.column())})
    elif combiner == "fixed_average":
        out = scored.withColumns({"pred_mean": mean_of(means), "pred_std": clipped(mean_of(scales))})
    else:
        raise ValueError(f"no combiner {combiner}")
    return out.drop("__x", "__block", "__refit", "fold", "ordinal", *column.values(), *terms)
