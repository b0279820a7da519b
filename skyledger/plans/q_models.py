"""Model fits, calibration and the rolling back-test over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import numeric as N
from skyledger.operators import bins as B
from skyledger.operators import gating as A
from skyledger.operators import models as M
from skyledger.operators import scoring as S
from skyledger.operators import stacking as G
from skyledger.operators import trade as T
from skyledger.plans import roles
from skyledger.plans.q_features import BIN_ROWS
from skyledger.plans.q_scoring import CRPS_SQL, MASS_SQL, PR_SQL, WIN_SQL
from skyledger.plans.registry import query
from skyledger.plans.roles import with_roles
from skyledger.session import short_methods, written
from skyledger.sources.tables import table


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


FIT_SQL = """m AS (SELECT regr_slope(y, mean) AS b, regr_intercept(y, mean) AS a FROM preds), r AS (SELECT p.*, a + b * mean AS pm, abs(y - a - b * mean) AS res FROM preds p, m),
  s AS (SELECT regr_slope(res, mean) AS b, regr_intercept(res, mean) AS a FROM r), o AS (SELECT r.*, greatest(s.a + s.b * mean, 0.5) AS ps FROM r, s)"""


def numbered(df):
    """Rows with a key of their own; equal rows differ in it, and writing fixes it."""
    return written(df.withColumn("rid", F.monotonically_increasing_id()), "numbered")


def least_squares_sql(rows: str, names: list[str], target: str, into: str, ridge: float = 0.0, train: str = "TRUE") -> str:
    """Common table expressions ending in table ``{into}_o``: ``rows`` with the least-squares prediction of ``target`` as column ``into``.

    The fit learns from the rows of ``train``. Centred columns are made orthogonal one after another, and the target is projected
    on each. A ridge adds one row a column that holds the root of the penalty there.
    """
    q, t, k = [f"{into}_q{i}" for i in range(len(names))], f"{into}_t", len(names)
    learned = f"FILTER (WHERE {train}) OVER ()"
    centred = ", ".join([*[f"({n})::DOUBLE - avg(({n})::DOUBLE) {learned} AS {c}" for n, c in zip(names, q)], f"({target})::DOUBLE - avg(({target})::DOUBLE) {learned} AS {t}"])
    out = f"{into}_c AS (SELECT *, {centred}, avg(({target})::DOUBLE) {learned} AS {into}, TRUE AS {into}_own, {train} AS {into}_in FROM {rows})"
    last = f"{into}_c"
    if ridge:
        extra = " ".join("UNION ALL BY NAME SELECT " + ", ".join(f"{ridge ** 0.5 if i == j else 0.0}::DOUBLE AS {c}" for j, c in enumerate(q)) + f", 0.0::DOUBLE AS {t}, 0.0::DOUBLE AS {into}, FALSE AS {into}_own, TRUE AS {into}_in" for i in range(k))
        out, last = f"{out}, {into}_r AS (SELECT * FROM {last} {extra})", f"{into}_r"
    total = f"FILTER (WHERE {into}_in) OVER ()"
    for i, c in enumerate(q):
        along = lambda v: f"{c} * (sum({v} * {c}) {total} / sum({c} * {c}) {total})"  # noqa: B023, E731
        moved = ", ".join([f"{v} - {along(v)} AS {v}" for v in [*q[i + 1 :], t]] + [f"{into} + {along(t)} AS {into}"])
        out += f", {into}_s{i} AS (SELECT * REPLACE ({moved}) FROM {last})"
        last = f"{into}_s{i}"
    return f"{out}, {into}_o AS (SELECT * EXCLUDE ({', '.join([*q, t, f'{into}_own', f'{into}_in'])}) FROM {last} WHERE {into}_own)"


@query("x06_gaussian_regression", with_roles("preds", f"WITH {FIT_SQL} SELECT city, count(*) AS n, round(avg(pm), 6) AS pred_mean, round(avg(ps), 6) AS pred_std, round(avg(abs(y - pm)), 6) AS mae FROM o GROUP BY 1"))
def x06(spark, sf):
    """Mean and spread regression fitted by one aggregate each."""
    p = roles.preds(spark, sf)
    out = M.fit_gaussian(p, ["mean"], "y").score(p)
    return out.groupBy("city").agg(
        F.count("*").alias("n"), F.round(F.avg("pred_mean"), 6).alias("pred_mean"), F.round(F.avg("pred_std"), 6).alias("pred_std"),
        F.round(F.avg(F.abs(F.col("y") - F.col("pred_mean"))), 6).alias("mae"),
    )


@query(
    "x06_weighted_ridge",
    with_roles(
        "preds",
        """WITH w AS (SELECT mean AS x, y, std AS w FROM preds), g AS (SELECT sum(w) AS sw, sum(w * x) AS sx, sum(w * x * x) + 50.0 AS sxx, sum(w * y) AS sy, sum(w * x * y) AS sxy FROM w)
    SELECT round((sw * sxy - sx * sy) / (sw * sxx - sx * sx), 8) AS slope, round((sy - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx) / sw, 8) AS intercept FROM g""",
    ),
)
def x06r(spark, sf):
    """Weighted ridge, the intercept free of penalty."""
    fit = M.fit_linear(roles.preds(spark, sf), ["mean"], "y", "std", ridge=50.0)
    one = roles.preds(spark, sf).agg(F.count("*").alias("n"))
    return one.select(F.round(F.lit(fit.coefficients[0]), 8).alias("slope"), F.round(F.lit(fit.intercept), 8).alias("intercept"))


GAP_SQL = "WITH g AS (SELECT *, CASE WHEN line % 3 = 0 THEN NULL ELSE mean END AS x FROM preds), md AS (SELECT median(x) AS md FROM g WHERE unit = 'C'), v AS (SELECT g.*, coalesce(x, md) AS z FROM g, md)"


@query(
    "x06_missing_features",
    with_roles(
        "preds",
        f"""{GAP_SQL}, m AS (SELECT regr_slope(y, z) AS b, regr_intercept(y, z) AS a FROM v WHERE unit = 'C'), s AS (SELECT regr_slope(abs(y - a - b * z), z) AS sb, regr_intercept(abs(y - a - b * z), z) AS sa FROM v, m WHERE unit = 'C')
    SELECT city, unit, count(*) AS n, round(avg(a + b * z), 6) AS pred_mean, round(avg(greatest(sa + sb * z, 0.5)), 6) AS pred_std FROM v, m, s GROUP BY ALL""",
    ),
)
def x06m(spark, sf):
    """A third of the features missing in the fit and when scoring."""
    p = roles.preds(spark, sf).withColumn("x", F.when(F.col("line") % 3 != 0, F.col("mean")))
    return means_by_unit(M.fit_gaussian(p.where("unit = 'C'"), ["x"], "y").score(p))


@query(
    "x06_missing_at_scoring",
    with_roles(
        "preds",
        """WITH c AS (SELECT * FROM preds WHERE unit = 'C'), m AS (SELECT regr_slope(y, mean) AS b, regr_intercept(y, mean) AS a, median(mean) AS md FROM c), s AS (SELECT regr_slope(abs(y - a - b * mean), mean) AS sb, regr_intercept(abs(y - a - b * mean), mean) AS sa FROM c, m),
    v AS (SELECT p.*, CASE WHEN line % 3 = 0 THEN md ELSE mean END AS z FROM preds p, m WHERE unit = 'F')
    SELECT city, unit, count(*) AS n, round(avg(a + b * z), 6) AS pred_mean, round(avg(greatest(sa + sb * z, 0.5)), 6) AS pred_std FROM v, m, s GROUP BY ALL""",
    ),
)
def x06s(spark, sf):
    """Fitted on complete rows; a third of the scored ones miss the feature."""
    p = roles.preds(spark, sf)
    fit = M.fit_gaussian(p.where("unit = 'C'"), ["mean"], "y")
    return means_by_unit(fit.score(p.where("unit = 'F'").withColumn("mean", F.when(F.col("line") % 3 != 0, F.col("mean")))))


def means_by_unit(df):
    return df.groupBy("city", "unit").agg(F.count("*").alias("n"), F.round(F.avg("pred_mean"), 6).alias("pred_mean"), F.round(F.avg("pred_std"), 6).alias("pred_std"))


@query(
    "x07_log_variance",
    with_roles(
        "preds",
        """WITH m AS (SELECT regr_slope(y, mean) AS b, regr_intercept(y, mean) AS a FROM preds), r AS (SELECT p.*, a + b * mean AS pm, ln(greatest(power(y - a - b * mean, 2), 1e-4)) AS res FROM preds p, m), s AS (SELECT regr_slope(res, mean) AS b, regr_intercept(res, mean) AS a FROM r)
    SELECT city, round(avg(pm), 6) AS pred_mean, round(avg(sqrt(greatest(exp(s.a + s.b * mean), 0.25))), 6) AS pred_std FROM r, s GROUP BY 1""",
    ),
)
def x07(spark, sf):
    p = roles.preds(spark, sf)
    out = M.fit_gaussian(p, ["mean"], "y", log_variance=True).score(p)
    return out.groupBy("city").agg(F.round(F.avg("pred_mean"), 6).alias("pred_mean"), F.round(F.avg("pred_std"), 6).alias("pred_std"))


TERMS = ["mean", "std", "mean * mean", "mean * std", "std * std"]


@query(
    "x08_polynomial",
    with_roles(
        "preds",
        f"""WITH {least_squares_sql('preds', TERMS, 'y', 'pm')}, {least_squares_sql('pm_o', TERMS, 'abs(y - pm)', 'pa')}, {least_squares_sql('pa_o', ['mean', 'std'], 'abs(y - pm)', 'pb')}
    SELECT city, round(avg(pm), 6) AS plain_mean, round(avg(greatest(pa, 0.5)), 6) AS plain_std, round(avg(pm), 6) AS scaled_mean, round(avg(greatest(pb, 0.5)), 6) AS scaled_std FROM pb_o GROUP BY 1""",
    ),
)
def x08(spark, sf):
    """Second-degree regression, plain and with standardized inputs."""
    p = written(roles.preds(spark, sf).select("city", "mean", "std", "y"), "polynomial-rows")
    wide, plain = M.fit_polynomial(p, ["mean", "std"], "y")
    a = plain.score(wide).groupBy("city").agg(F.avg("pred_mean").alias("plain_mean"), F.avg("pred_std").alias("plain_std"))
    wide, scaled = M.fit_polynomial(p, ["mean", "std"], "y", scale=True)
    b = scaled.score(wide).groupBy("city").agg(F.avg("pred_mean").alias("scaled_mean"), F.avg("pred_std").alias("scaled_std"))
    return rounded(a.join(b, "city"), "plain_mean", "plain_std", "scaled_mean", "scaled_std")


WIDE_SQL = "w AS (SELECT l_orderkey, max(l_quantity) FILTER (l_returnflag = 'A') AS a, max(l_quantity) FILTER (l_returnflag = 'N') AS n, max(l_quantity) FILTER (l_returnflag = 'R') AS r, avg(l_quantity) AS y FROM lineitem GROUP BY 1)"


def wide_models(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_orderkey").agg(
        *[F.max(F.when(F.col("l_returnflag") == m, F.col("l_quantity"))).alias(m.lower()) for m in "ANR"], F.avg("l_quantity").alias("y")
    )


@query(
    "x09_raw_baselines",
    f"WITH {WIDE_SQL} SELECT l_orderkey, round((SELECT avg(v) FROM (VALUES (a), (n), (r)) t(v)), 6) AS pred_mean, round(greatest(coalesce((SELECT stddev_samp(v) FROM (VALUES (a), (n), (r)) t(v)), 2), 0.5), 6) AS pred_std FROM w",
)
def x09(spark, sf):
    """Average of the available models and their sample deviation."""
    return rounded(M.raw_average(wide_models(spark, sf), ["a", "n", "r"]).select("l_orderkey", "pred_mean", "pred_std"), "pred_mean", "pred_std")


@query(
    "x10_family_blend",
    f"WITH {WIDE_SQL} SELECT l_orderkey, round((SELECT avg(v) FROM (VALUES (a), (n), (r)) t(v)), 6) AS pred_mean, round(greatest(abs((SELECT avg(v) FROM (VALUES (a), (n)) t(v)) - r), 0.5), 6) AS pred_std FROM w WHERE r IS NOT NULL AND coalesce(a, n) IS NOT NULL",
)
def x10(spark, sf):
    """Blend of two families, their disagreement as the spread."""
    w = wide_models(spark, sf).where(F.col("r").isNotNull() & F.coalesce("a", "n").isNotNull())
    return rounded(M.blend(w, ["a", "n"], ["r"], "y", learned=False).select("l_orderkey", "pred_mean", "pred_std"), "pred_mean", "pred_std")


@query(
    "x10_neighbor_ridge",
    with_roles(
        "preds",
        f"""WITH {least_squares_sql('preds', ['mean', 'mean + std', 'std'], 'y', 'pr', 1.0)}, {least_squares_sql('pr_o', ['mean', 'mean + std'], 'y', 'pl')}
    SELECT city, round(avg(pr), 6) AS ridge_mean, round(avg(greatest(std, 0.5)), 6) AS ridge_std, round(avg(pl), 6) AS blend_mean FROM pl_o GROUP BY 1""",
    ),
)
def x10n(spark, sf):
    """Learned blend and neighbour ridge, scored by city."""
    p = written(roles.preds(spark, sf).select("city", "mean", "std", "y"), "neighbor-rows")
    p = p.withColumn("nb", F.col("mean") + F.col("std")).withColumn("sp", F.col("std"))
    out = M.neighbor_ridge(p, ["mean"], "y", "nb", "sp")
    learned = M.blend(out.drop("pred_mean", "pred_std"), ["mean"], ["nb"], "y").groupBy("city").agg(F.avg("pred_mean").alias("blend_mean"))
    joined = out.groupBy("city").agg(F.avg("pred_mean").alias("ridge_mean"), F.avg("pred_std").alias("ridge_std")).join(learned, "city")
    return rounded(joined, "ridge_mean", "ridge_std", "blend_mean")


ISO_SQL = f"""{PR_SQL.replace('pr AS (', 'pr AS MATERIALIZED (')}, {MASS_SQL},
  l AS (SELECT rid, city, label, round(prob, 9) AS p, CAST(label = {WIN_SQL} AS INT) AS hit FROM prob),
  u AS (SELECT label, p, count(*) AS w, sum(hit) AS h, row_number() OVER (PARTITION BY label ORDER BY p) AS i FROM l GROUP BY label, p),
  c AS (SELECT *, sum(w) OVER o AS cw, sum(h) OVER o AS ch FROM u WINDOW o AS (PARTITION BY label ORDER BY i)),
  m AS (SELECT a.label, a.i AS j, b.i, min((b.ch - a.ch + a.h) / (b.cw - a.cw + a.w)) OVER (PARTITION BY a.label, a.i ORDER BY b.i DESC) AS least FROM c a JOIN c b ON a.label = b.label AND b.i >= a.i),
  iso AS (SELECT label, p, max(least) AS value FROM m JOIN u USING (label, i) GROUP BY ALL),
  n AS (SELECT l.*, value / nullif(sum(value) OVER (PARTITION BY rid), 0) AS scaled, value FROM l JOIN iso USING (label, p))"""


@query(
    "x05_isotonic_calibration",
    with_roles("preds", f"WITH {ISO_SQL} SELECT label, count(*) AS n, round(avg(coalesce(scaled, value)), 6) AS calibrated, round(avg(hit), 6) AS hit_rate FROM n GROUP BY 1"),
)
def x05(spark, sf):
    """Isotonic calibration per outcome label (in SQL by its max-min form), then scaled per decision."""
    bins = B.bin_array(BIN_ROWS)
    p = numbered(roles.preds(spark, sf).select("mean", "std", "y"))
    p = p.withColumn("probs", B.labeled(bins, B.normal_masses(bins, F.col("mean"), F.col("std")))).withColumn("winner", B.winning_label(bins, F.col("y")))
    long = p.select("rid", "winner", F.inline_outer("probs")).withColumn("hit", F.col("label") == F.col("winner"))
    long = written(long.select("rid", "label", F.round("prob", 9).alias("prob"), "hit"), "probabilities")
    blocks = M.fit_isotonic(long, "label", "prob", "hit", ["rid"])
    out = M.renormalize(M.apply_isotonic(long, blocks, "label", "prob"), ["rid"], "calibrated")
    return out.groupBy("label").agg(
        F.count("*").alias("n"), F.round(F.avg("calibrated"), 6).alias("calibrated"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate")
    )


CAL = dict(blend_per_c=0.3, max_blend=0.6, base_scale=1.1, disagreement_weight=0.2, range_weight=0.1, fallback_weight=0.5)


def paired(spark, sf):
    """Primary and fallback Gaussians per prediction."""
    return roles.preds(spark, sf).withColumns(
        {
            "primary_mean": F.col("mean"), "primary_std": F.col("std"), "fallback_mean": F.col("mean") * 0.9 + 3,
            "fallback_std": F.lit(2.5), "source_range": F.col("std") / 2,
        }
    )


PAIR_SQL = """c AS (SELECT *, CASE WHEN unit = 'F' THEN (mean - 32) * 5 / 9 ELSE mean END AS pm, greatest(CASE WHEN unit = 'F' THEN std * 5 / 9 ELSE std END, FLOOR) AS ps,
    CASE WHEN unit = 'F' THEN (mean * 0.9 + 3 - 32) * 5 / 9 ELSE mean * 0.9 + 3 END AS fm, greatest(CASE WHEN unit = 'F' THEN 2.5::DOUBLE * 5 / 9 ELSE 2.5 END, FLOOR) AS fs, std / 2 AS sr FROM preds)"""
OUT_SQL = "SELECT city, unit, round(avg(CASE WHEN unit = 'F' THEN m * 9 / 5 + 32 ELSE m END), 6) AS pred_mean, round(avg(CASE WHEN unit = 'F' THEN s * 9 / 5 ELSE s END), 6) AS pred_std FROM o GROUP BY ALL"


def by_city(df):
    return df.groupBy("city", "unit").agg(F.round(F.avg("pred_mean"), 6).alias("pred_mean"), F.round(F.avg("pred_std"), 6).alias("pred_std"))


@query(
    "x11_disagreement_calibration",
    with_roles("preds", f"""WITH {PAIR_SQL.replace('FLOOR', '0.5')}, b AS (SELECT *, least(greatest(0.3 * abs(pm - fm), 0), 0.6) AS w FROM c),
    o AS (SELECT *, (1 - w) * pm + w * fm AS m, least(greatest(sqrt(greatest(power(ps * 1.1, 2) + 0.2 * power(pm - fm, 2) + 0.1 * sr * sr + 0.5 * greatest(fs * fs - ps * ps, 0) + w * (1 - w) * power(pm - fm, 2), 0.25)), 0.5), 12) AS s FROM b) {OUT_SQL}"""),
)
def x11(spark, sf):
    return by_city(M.disagreement_calibrated(paired(spark, sf), "unit", "source_range", **CAL))


@query(
    "x12_tail_calibration",
    with_roles("preds", f"""WITH {PAIR_SQL.replace('FLOOR', '0.1')}, b AS (SELECT *, ps < 1.5 AS k, greatest(ps * 1.2 + 0.1, 0.5) AS s0 FROM c),
    o AS (SELECT *, CASE WHEN k THEN 0.6 * (pm + 0.2) + 0.4 * fm ELSE pm + 0.2 END AS m, greatest(CASE WHEN k THEN greatest(s0, fs) ELSE s0 END, 0.5) AS s FROM b) {OUT_SQL}"""),
)
def x12(spark, sf):
    out = M.tail_calibrated(paired(spark, sf), "unit", shift=0.2, multiplier=1.2, additive=0.1, mean_weight=0.4, std_mode="max", std_threshold=1.5)
    return by_city(out)


@query(
    "x13_gated_mixture",
    with_roles("preds", f"""WITH {PAIR_SQL.replace('FLOOR', '0.1')}, b AS (SELECT *, least(greatest(mean / 60, 0.1), 0.9) AS w FROM c), x AS (SELECT *, (1 - w) * pm + w * fm AS m FROM b),
    o AS (SELECT *, greatest(sqrt(greatest((1 - w) * (ps * ps + power(pm - m, 2)) + w * (fs * fs + power(fm - m, 2)), 0)), 0.1) AS s FROM x) {OUT_SQL}"""),
)
def x13(spark, sf):
    """Mixture moments of a given gate weight."""
    return by_city(M.gated_mixture(paired(spark, sf).withColumn("g", F.col("mean") / 60), "g", "unit", low=0.1, high=0.9))


@query("x13_source_gate")
def x13g(spark, sf):
    """Gate learned from which source scores better, then its mixture."""
    p = paired(spark, sf)
    p = N.with_gaussian_crps(p, "primary_mean", "primary_std", "y", "primary_crps")
    p = N.with_gaussian_crps(p, "fallback_mean", "fallback_std", "y", "fallback_crps")
    p = p.withColumn("gap", F.col("primary_mean") - F.col("fallback_mean"))
    g = M.source_gate(p, ["mean", "std", "gap"])
    out = M.gated_mixture(g, "fallback_weight", "unit", low=0.05, high=0.95)
    return out.groupBy("city").agg(F.avg("fallback_weight").alias("fallback_weight"), F.avg(F.abs(F.col("y") - F.col("pred_mean"))).alias("mae"), F.avg("pred_std").alias("pred_std"))


GATE_ABOUT = dict(lead_hours="line", target_date="target_date", one_hot=("decision_horizon",))


def gated(spark, sf):
    """Primary and fallback with two sources, one of them missing for a third of the rows."""
    p = paired(spark, sf).withColumns({"s1": F.col("mean") + 1, "s2": F.when(F.col("line") % 3 != 0, F.col("mean") * 0.95)})
    p = p.drop("market_id", "country", "model_name", "mean", "std", "source_range")  # rows are written: without what is not used
    return A.source_gated(p, "y", "unit", {"one": "s1", "two": "s2"}, ["target_date"], low=0.05, high=0.95, weight_mode="fallback_regret", **GATE_ABOUT)


GATE_SQL = f"""{PAIR_SQL.replace('FLOOR', '0.1')}, x AS (SELECT *, CASE WHEN unit = 'F' THEN (y - 32) * 5 / 9 ELSE y END AS yc FROM c),
  s AS (SELECT *, {CRPS_SQL.replace('mean', 'pm').replace('std', 'ps').replace('(y ', '(yc ')} AS pc, {CRPS_SQL.replace('mean', 'fm').replace('std', 'fs').replace('(y ', '(yc ')} AS fc FROM x)"""


@query(
    "x13_gate_facts",
    with_roles("preds", f"WITH {GATE_SQL} SELECT city, unit, count(*) AS n, round(avg(pc), 6) AS primary_crps, round(avg(fc), 6) AS fallback_crps, round(avg(CAST(fc < pc AS INT)), 6) AS fallback_better, count(*) AS weight_in_range, count(*) AS mean_between, true AS better_than_primary FROM s GROUP BY ALL"),
)
def x13f(spark, sf):
    """Learned gate scored on later folds: both scores, and what holds of every gate and mixture."""
    g = gated(spark, sf)
    low, high = F.least("primary_mean", "fallback_mean"), F.greatest("primary_mean", "fallback_mean")
    between = F.col("pred_mean").between(low - 1e-9, high + 1e-9)
    g = N.with_gaussian_crps(g, "pred_mean", "pred_std", "y", "mixed")
    g = N.with_gaussian_crps(g, "primary_mean", "primary_std", "y", "primary")
    scores = ("mixed", "primary")
    # sums are written: all rows are scored once, for the groups and for the whole
    groups = g.groupBy("city", "unit").agg(
        *[f(s).alias(f"__{s}_{n}") for s in scores for n, f in (("sum", F.sum), ("n", F.count))],
        F.count("*").alias("n"), F.round(F.avg("primary_crps"), 6).alias("primary_crps"), F.round(F.avg("fallback_crps"), 6).alias("fallback_crps"),
        F.round(F.avg((F.col("fallback_crps") < F.col("primary_crps")).cast("int")), 6).alias("fallback_better"),
        F.count(F.when(F.col("fallback_weight").between(0.05, 0.95), 1)).alias("weight_in_range"), F.count(F.when(between, 1)).alias("mean_between"),
    )
    with short_methods(spark):
        groups = written(groups, "gate-facts")
    mixed, primary = (F.sum(f"__{s}_sum") / F.nullif(F.sum(f"__{s}_n"), F.lit(0)) for s in scores)
    whole = groups.agg((mixed < primary).alias("better")).scalar()
    return groups.drop(*[f"__{s}_{n}" for s in scores for n in ("sum", "n")]).withColumn("better_than_primary", whole)


@query(
    "x14_pretrained_features",
    with_roles(
        "preds",
        """WITH c AS (SELECT *, CASE WHEN unit = 'F' THEN (mean - 32) * 5 / 9 ELSE mean END AS xc, CASE WHEN unit = 'F' THEN (y - 32) * 5 / 9 ELSE y END AS yc FROM preds), m AS (SELECT regr_slope(yc, xc) AS b, regr_intercept(yc, xc) AS a FROM c),
    o AS (SELECT city, unit, mean, CASE WHEN unit = 'F' THEN (a + b * xc) * 9 / 5 + 32 ELSE a + b * xc END AS pm FROM c, m) SELECT city, unit, round(avg(pm), 6) AS weather_pretrain_mean, round(avg(pm - mean), 6) AS weather_pretrain_delta FROM o GROUP BY ALL""",
    ),
)
def x14(spark, sf):
    """Predictions of a Celsius model as features in market units."""
    u = F.col("unit")
    p = roles.preds(spark, sf).withColumn("xc", N.to_celsius(F.col("mean"), u)).withColumn("yc", N.to_celsius(F.col("y"), u))
    out = M.with_pretrained(p, M.fit_gaussian(p, ["xc"], "yc"), "unit", "mean")
    return out.groupBy("city", "unit").agg(
        F.round(F.avg("weather_pretrain_mean"), 6).alias("weather_pretrain_mean"), F.round(F.avg("weather_pretrain_delta"), 6).alias("weather_pretrain_delta")
    )


@query(
    "x15_boosted_facts",
    with_roles("preds", "SELECT unit, count(*) AS n, count(*) AS std_in_range, count(pm) AS predicted, true AS better_than_mean FROM (SELECT *, avg(y) OVER () AS pm FROM preds) GROUP BY 1"),
)
def x15f(spark, sf):
    """What holds of every boosted mean and scale: all rows scored, scales in range, better than the mean."""
    p = roles.preds(spark, sf).select("unit", "target_date", "mean", "std", "y")
    out = M.boosted_gaussian(p, ["mean", "std"], "y", ["target_date"])
    mean = out.agg(F.avg("y").alias("m")).scalar()
    better = out.withColumn("__m", mean).agg((F.avg(F.abs(F.col("y") - F.col("pred_mean"))) < F.avg(F.abs(F.col("y") - F.col("__m")))).alias("b")).scalar()
    return out.groupBy("unit").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("pred_std").between(0.25, 12.0), 1)).alias("std_in_range"), F.count("pred_mean").alias("predicted")
    ).withColumn("better_than_mean", better)


@query("x15_boosted_gaussian")
def x15(spark, sf):
    """Boosted mean and scale with out-of-fold residuals."""
    p = roles.preds(spark, sf).select("model_name", "target_date", "mean", "std", "y")
    out = M.boosted_gaussian(p, ["mean", "std"], "y", ["target_date"])
    return S.point_scores(out, "pred_mean", "pred_std", "y", ["model_name"])


def expert_sql(rows: str, tag: str, train: str) -> str:
    """Means of the two ridge experts (``mb_tag``, ``ml_tag``) learned from the rows of ``train``."""
    z = f"(mean - z_m{tag}) / z_s{tag}"
    return f"""z{tag} AS (SELECT *, avg(mean) FILTER (WHERE {train}) OVER () AS z_m{tag}, stddev_pop(mean) FILTER (WHERE {train}) OVER () AS z_s{tag} FROM {rows}),
  {least_squares_sql(f'z{tag}', ['mean', 'std'], 'y', f'mb{tag}', 1.0, train)}, {least_squares_sql(f'mb{tag}_o', [z, f'{z} * {z}'], 'y', f'ml{tag}', 1.0, train)}"""


STACK_SQL = f"""WITH d AS (SELECT target_date, row_number() OVER (ORDER BY target_date) - 1 AS ordinal, count(*) OVER () AS n FROM (SELECT DISTINCT target_date FROM preds)),
  s AS (SELECT *, greatest(n // 5, 1) AS size, greatest(16, greatest(n // 5, 1)) AS first FROM d),
  r AS (SELECT city, mean, std, y, ordinal, first, size, CASE WHEN ordinal >= first AND first + ((ordinal - first) // size + 1) * size <= n THEN (ordinal - first) // size END AS fold FROM preds JOIN s USING (target_date)),
  {', '.join(expert_sql('r' if k == 0 else f'ml{k - 1}_o', str(k), f'ordinal < first + {k} * size') for k in range(4))}, {expert_sql('ml3_o', 'w', 'TRUE')},
  u AS (SELECT city, mean, std, y, TRUE AS oof, CASE fold WHEN 0 THEN mb0 WHEN 1 THEN mb1 WHEN 2 THEN mb2 ELSE mb3 END AS mb, CASE fold WHEN 0 THEN ml0 WHEN 1 THEN ml1 WHEN 2 THEN ml2 ELSE ml3 END AS ml FROM mlw_o WHERE fold IS NOT NULL
    UNION ALL SELECT city, mean, std, y, FALSE, mbw, mlw FROM mlw_o),
  {least_squares_sql('u', ['mb', 'ml'], 'y', 'pm', 1.0, 'oof')}, {least_squares_sql('pm_o', ['mean', 'std'], 'least(greatest(abs(y - pm), 0.25), 12)', 'ps', 1.0, 'oof')}"""


@query(
    "x16_ridge_stacker",
    with_roles("preds", f"{STACK_SQL} SELECT city, count(*) AS n, round(avg(mb), 6) AS mean_blend, round(avg(ml), 6) AS mean_leadtime, round(avg(pm), 6) AS pred_mean, round(avg(least(greatest(ps, 0.25), 12)), 6) AS pred_std FROM ps_o WHERE NOT oof GROUP BY 1"),
)
def x16r(spark, sf):
    """Two ridge experts fitted for all folds at once, and a ridge on their out-of-fold means."""
    p = roles.preds(spark, sf).select("city", "target_date", "mean", "std", "y")
    out = G.stacked_gaussian(p, ["mean", "std"], ["mean"], "y", ["target_date"], experts=("blend", "leadtime"), combiner="linear_stacker")
    names = ("mean_blend", "mean_leadtime", "pred_mean", "pred_std")
    return rounded(out.groupBy("city").agg(F.count("*").alias("n"), *[F.avg(n).alias(n) for n in names]), *names)


@query("x16_stacked_experts")
def x16(spark, sf):
    """Stacked experts with a gate, and their diagnostics."""
    p = roles.preds(spark, sf).select("target_date", "mean", "std", "y")
    out = G.stacked_gaussian(p, ["mean", "std"], ["mean"], "y", ["target_date"])
    e = ["blend", "leadtime", "tree"]
    return S.expert_diagnostics(out, [f"mean_{x}" for x in e], [f"weight_{x}" for x in e], "y", [f"scale_{x}" for x in e])


BACK_SQL = """d AS (SELECT target_date, row_number() OVER (ORDER BY target_date) - 1 AS ordinal FROM (SELECT DISTINCT target_date FROM preds)),
  p AS (SELECT preds.*, ordinal, CASE WHEN ordinal < 500 THEN 0 ELSE (ordinal - 500) // 250 + 1 END AS block FROM preds JOIN d USING (target_date)),
  k AS (SELECT unnest(generate_series(0, (SELECT max(block) - 1 FROM p))) AS refit), f AS (SELECT refit, regr_slope(y, mean) AS b, regr_intercept(y, mean) AS a FROM p JOIN k ON block <= refit GROUP BY 1),
  g AS (SELECT f.refit, any_value(a) AS a, any_value(b) AS b, regr_slope(abs(y - a - b * mean), mean) AS sb, regr_intercept(abs(y - a - b * mean), mean) AS sa FROM p JOIN f ON block <= f.refit GROUP BY 1),
  t AS (SELECT p.*, g.refit, a + b * mean AS pm, greatest(sa + sb * mean, 0.5) AS ps FROM p JOIN g ON g.refit = block - 1)"""


def backtest(spark, sf):
    # written once: the dates' order and the rows are read apart
    rows = written(roles.preds(spark, sf).select("city", "decision_horizon", "target_date", "mean", "std", "y"), "backtest-rows")
    return M.rolling_backtest(rows, ["mean"], "y", ["target_date"], 500, 1, 250)


@query("x17_rolling_backtest", with_roles("preds", f"WITH {BACK_SQL} SELECT CAST(refit AS INT) AS refit, count(*) AS n, round(avg(pm), 6) AS pred_mean, round(avg(ps), 6) AS pred_std, round(avg(abs(y - pm)), 6) AS mae FROM t GROUP BY 1"))
def x17(spark, sf):
    """All expanding fits at once, every test day scored by its own fit."""
    return by_refit(backtest(spark, sf))


def by_refit(df):
    return df.groupBy("refit").agg(
        F.count("*").alias("n"), F.round(F.avg("pred_mean"), 6).alias("pred_mean"), F.round(F.avg("pred_std"), 6).alias("pred_std"),
        F.round(F.avg(F.abs(F.col("y") - F.col("pred_mean"))), 6).alias("mae"),
    )


GAP_BACK_SQL = BACK_SQL.split("f AS (")[0].replace("preds.*", "preds.*, CASE WHEN line % 3 = 0 THEN NULL ELSE mean END AS x") + """md AS (SELECT refit, median(x) AS md FROM p JOIN k ON block <= refit GROUP BY 1),
  f AS (SELECT refit, any_value(md) AS md, regr_slope(y, coalesce(x, md)) AS b, regr_intercept(y, coalesce(x, md)) AS a FROM p JOIN md ON block <= refit GROUP BY 1),
  g AS (SELECT f.refit, any_value(md) AS md, any_value(a) AS a, any_value(b) AS b, regr_slope(abs(y - a - b * coalesce(x, md)), coalesce(x, md)) AS sb, regr_intercept(abs(y - a - b * coalesce(x, md)), coalesce(x, md)) AS sa FROM p JOIN f ON block <= f.refit GROUP BY 1),
  t AS (SELECT p.*, g.refit, a + b * coalesce(x, md) AS pm, greatest(sa + sb * coalesce(x, md), 0.5) AS ps FROM p JOIN g ON g.refit = block - 1)"""


@query("x17_missing_features", with_roles("preds", f"WITH {GAP_BACK_SQL} SELECT CAST(refit AS INT) AS refit, count(*) AS n, round(avg(pm), 6) AS pred_mean, round(avg(ps), 6) AS pred_std, round(avg(abs(y - pm)), 6) AS mae FROM t GROUP BY 1"))
def x17m(spark, sf):
    """A third of the features missing: every refit fills with the median of what it has seen."""
    p = roles.preds(spark, sf).withColumn("x", F.when(F.col("line") % 3 != 0, F.col("mean")))
    return by_refit(M.rolling_backtest(p, ["x"], "y", ["target_date"], 500, 1, 250))


TRADES_SQL = f"""d0 AS MATERIALIZED (SELECT row_number() OVER () AS did, decision_horizon, y, pm, ps, mean, std FROM t),
  pr AS (SELECT did AS rid, did, decision_horizon, y, 'fair' AS kind, pm AS mean, ps AS std FROM d0 UNION ALL SELECT -did, did, decision_horizon, y, 'crowd', mean, std * 2 FROM d0), {MASS_SQL},
  o AS (SELECT f.did, f.decision_horizon, f.y, f.ordinal, f.label, f.prob AS fair, round(c.prob, 4) AS price FROM prob f JOIN prob c ON c.did = f.did AND c.ordinal = f.ordinal AND f.kind = 'fair' AND c.kind = 'crowd'),
  e AS (SELECT *, CASE WHEN price > 0.001 AND price BETWEEN 0.01 AND 0.99 THEN fair - price - price * 30 / 10000 END AS edge FROM o),
  b AS (SELECT any_value(decision_horizon) AS decision_horizon, any_value(y) AS y, arg_max({{'l': label, 'p': price, 'e': edge}}, (edge, -ordinal)) FILTER (edge >= 0.01) AS best FROM e GROUP BY did),
  s AS (SELECT decision_horizon, best.e AS edge, best.p AS price, (CASE WHEN best.l = {WIN_SQL} THEN 1 ELSE 0 END - best.p) * (10.0 / greatest(best.p, 1e-6)) - 0.03 AS pnl FROM b WHERE best IS NOT NULL)"""


@query(
    "x17_backtest_trades",
    with_roles("preds", f"WITH {BACK_SQL}, {TRADES_SQL} SELECT decision_horizon, count(*) AS num_trades, round(sum(pnl), 4) AS pnl, round(avg(CAST(pnl > 0 AS INT)), 6) AS hit_rate, round(avg(edge), 6) AS avg_edge, round(avg(price), 6) AS avg_price FROM s GROUP BY 1"),
)
def x17t(spark, sf):
    """Back-test to trades: fit, bin mass, price, best edge, settlement, summary."""
    bins = B.bin_array(BIN_ROWS)
    t = numbered(backtest(spark, sf)).withColumn("winner", B.winning_label(bins, F.col("y")))
    masses = B.normal_masses(bins, F.col("pred_mean"), F.col("pred_std"))
    crowd = B.normal_masses(bins, F.col("mean"), F.col("std") * 2)
    t = t.withColumn("fair", B.labeled(bins, masses)).withColumn("market", B.labeled(bins, crowd))
    rows = t.select("rid", "decision_horizon", "city", "winner", F.posexplode(F.arrays_zip("fair", "market")).alias("ordinal", "o"))
    rows = rows.select(
        "rid", "decision_horizon", "city", "winner", "ordinal", F.col("o.fair.label").alias("outcome_label"),
        F.col("o.fair.prob").alias("fair_probability"), F.round("o.market.prob", 4).alias("market_price"),
    ).withColumn("coverage_status", F.when(F.col("market_price") > 0.001, "ok").otherwise("missing")).withColumn("executable_price", F.col("market_price"))
    best = T.best_trades(rows, ["rid", "decision_horizon", "city", "winner"], ["ordinal"], 0.01, 0.99, 0.01)
    won = F.col("outcome_label") == F.col("winner")
    size = 10.0 / F.greatest(F.col("executable_price"), F.lit(1e-6))
    traded = best.where(F.col("outcome") == "traded").withColumn("realized_pnl", T.settle(F.col("executable_price"), size, won, F.lit("buy"), T.fee(F.lit(10.0))))
    from skyledger.operators.reports import trade_summary

    out = trade_summary(traded.withColumnRenamed("executable_price", "price"), ["decision_horizon"])
    return rounded(rounded(out, "pnl", digits=4), "hit_rate", "avg_edge", "avg_price")
