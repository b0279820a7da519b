"""Bins, predictive distributions, scores and leaderboards over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import numeric as N
from skyledger.operators import bins as B
from skyledger.operators import scoring as S
from skyledger.plans import roles
from skyledger.plans.q_features import BIN_ROWS, BINS_SQL
from skyledger.plans.registry import query
from skyledger.plans.roles import with_roles
from skyledger.sources.tables import table

BINS = BIN_ROWS


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def cdf_sql(z: str) -> str:
    """The same published approximation as an SQL expression over ``z``."""

    def horner(cs):
        out = repr(cs[0])
        for c in cs[1:]:
            out = f"({out} * a + {c!r})"
        return out

    tail = "a + 0.65"
    for k in (4, 3, 2, 1):
        tail = f"a + {k}.0 / ({tail})"
    up = f"CASE WHEN a > 37 THEN 0 WHEN a < {N.CDF_CENTRAL_LIMIT!r} THEN exp(-a * a / 2) * {horner(N.CDF_NUMERATOR)} / {horner(N.CDF_DENOMINATOR)} ELSE exp(-a * a / 2) / ({tail}) / 2.506628274631 END"
    # Literals are cast so that the arithmetic stays in double precision.
    import re

    up = re.sub(r"(?<![\w.])(\d+\.\d+(?:e-\d+)?)", r"CAST(\1 AS DOUBLE)", up)
    body = f"CASE WHEN z > 0 THEN 1 - ({up}) ELSE {up} END".replace(" a ", " abs(z) ").replace("-a ", "-abs(z) ").replace("(a ", "(abs(z) ")
    body = body.replace(" a)", " abs(z))")
    return re.sub(r"\bz\b", f"({z})", body)


MASS_SQL = f"""{BINS_SQL}, zb AS (SELECT p.*, b.ordinal, b.label, b.lower, b.upper, CASE WHEN b.upper IS NOT NULL THEN (b.upper + 0.5 - mean) / greatest(std, 1e-6) END AS zh,
    CASE WHEN b.lower IS NOT NULL THEN (b.lower - 0.5 - mean) / greatest(std, 1e-6) END AS zl FROM pr p, bins b),
  mass AS (SELECT *, greatest(CASE WHEN zh IS NULL THEN 1 ELSE {cdf_sql('zh')} END - CASE WHEN zl IS NULL THEN 0 ELSE {cdf_sql('zl')} END, 0) AS m FROM zb),
  prob AS (SELECT *, m / sum(m) OVER (PARTITION BY rid) AS prob FROM mass)"""
PR_SQL = "pr AS (SELECT row_number() OVER () AS rid, * FROM preds)"
WIN_SQL = "CASE WHEN y < 5.5 THEN '<=5' WHEN y < 10.5 AND y >= 5.5 THEN '6-10' WHEN y >= 10.5 AND y < 20.5 THEN '11-20' WHEN y >= 20.5 AND y < 21.5 THEN '21' WHEN y < 35.5 THEN '22-35' ELSE '>=36' END"


def probs(spark, sf):
    bins = B.bin_array(BINS)
    p = roles.preds(spark, sf)
    p = p.withColumn("probs", B.labeled(bins, B.normal_masses(bins, F.col("mean"), F.col("std"))))
    return p.withColumn("winner", B.winning_label(bins, F.col("y")))


@query("x01_normal_bins", with_roles("preds", f"WITH {PR_SQL}, {MASS_SQL} SELECT city, label, count(*) AS n, round(avg(prob), 6) AS prob, round(max(prob), 6) AS max_prob FROM prob GROUP BY ALL"))
def x01(spark, sf):
    """Gaussian mass per outcome bin for every prediction."""
    # outer: a plain inline lets the optimizer test the array's size, which computes the masses twice
    long = probs(spark, sf).select("city", F.inline_outer("probs"))
    return long.groupBy("city", "label").agg(F.count("*").alias("n"), F.round(F.avg("prob"), 6).alias("prob"), F.round(F.max("prob"), 6).alias("max_prob"))


@query(
    "x02_sample_bins",
    f"""WITH {BINS_SQL}, v AS (SELECT vec_id, label AS cls, unnest(embedding)::DOUBLE * 100 + 15 AS s FROM embeddings),
    m AS (SELECT vec_id, b.label, count(*) FILTER (s >= coalesce(b.lower - 0.5, -1e9) AND s < coalesce(b.upper + 0.5, 1e9)) / count(*) AS p FROM v, bins b GROUP BY ALL)
    SELECT vec_id, label, round(p / sum(p) OVER (PARTITION BY vec_id), 6) AS prob FROM m""",
)
def x02(spark, sf):
    """Share of samples per outcome bin."""
    bins = B.bin_array(BINS)
    e = table(spark, sf, "embeddings").withColumn("s", F.transform("embedding", lambda v: v.cast("double") * 100 + 15))
    out = e.select("vec_id", F.inline(B.labeled(bins, B.sample_masses(bins, F.col("s")))))
    return rounded(out, "prob")


@query("x03_normal_cdf", with_roles("preds", f"SELECT l, count(*) AS n, round(avg(c), 9) AS cdf FROM (SELECT model_name AS l, {cdf_sql('(y - mean) / std')} AS c FROM preds) GROUP BY 1"))
def x03(spark, sf):
    c = N.normal_cdf(F.col("y"), F.col("mean"), F.col("std"))
    return roles.preds(spark, sf).groupBy(F.col("model_name").alias("l")).agg(F.count("*").alias("n"), F.round(F.avg(c), 9).alias("cdf"))


@query(
    "x04_mixture_moments",
    """WITH w AS (SELECT l_orderkey, sum(l_extendedprice * l_quantity) / sum(l_extendedprice) AS m, sum(l_extendedprice * ((1 + l_tax) * (1 + l_tax) + l_quantity * l_quantity)) / sum(l_extendedprice) AS q FROM lineitem GROUP BY 1)
    SELECT l_orderkey, round(m, 6) AS mean, round(sqrt(greatest(q - m * m, 1e-12)), 4) AS std FROM w""",
)
def x04(spark, sf):
    """Mean and deviation of Gaussian mixtures held as arrays (lines of an order)."""
    li = table(spark, sf, "lineitem")
    arrays = li.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_extendedprice").alias("w"), F.col("l_quantity").alias("m"), (1 + F.col("l_tax")).alias("s"))).alias("c"))
    out = arrays.select("l_orderkey", N.mixture_moments(F.col("c.w"), F.col("c.m"), F.col("c.s")).alias("x")).select("l_orderkey", "x.*")
    return rounded(rounded(out, "mean"), "std", digits=4)


@query("j05_winning_bins", with_roles("preds", f"SELECT {WIN_SQL} AS winner, count(*) AS n FROM preds GROUP BY 1"))
def j05(spark, sf):
    """Settlement bin of every observation (half-open, flags ignored)."""
    return probs(spark, sf).groupBy("winner").agg(F.count("*").alias("n"))


@query(
    "j05_range_join",
    """WITH b AS (SELECT s_nationkey AS nk, s_suppkey AS ordinal, s_name AS label, CASE WHEN s_acctbal > 1000 THEN floor(s_acctbal / 1000) * 1000 END AS lower, CASE WHEN s_acctbal < 9000 THEN floor(s_acctbal / 1000) * 1000 + 999 END AS upper FROM supplier)
    SELECT c_custkey, (SELECT arg_min(label, ordinal) FROM b WHERE nk = c_nationkey AND c_acctbal >= coalesce(lower - 0.5, -1e9) AND c_acctbal < coalesce(upper + 0.5, 1e9)) AS winning_label FROM customer""",
)
def j05r(spark, sf):
    """Table form: equi-join on the market key with the range as a filter."""
    base = F.floor(F.col("s_acctbal") / 1000) * 1000
    b = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("c_nationkey"),
        F.col("s_suppkey").alias("ordinal"),
        F.col("s_name").alias("label"),
        F.when(F.col("s_acctbal") > 1000, base).alias("lower"),
        F.when(F.col("s_acctbal") < 9000, base + 999).alias("upper"),
    )
    return B.range_join_bins(table(spark, sf, "customer"), b, ["c_nationkey"], "c_acctbal").select("c_custkey", "winning_label")


FLAGGED = [("a", None, 10.0, True, False), ("b", 10.0, 20.0, True, True), ("c", 20.0, 30.0, False, False), ("d", 30.0, None, False, True)]


@query(
    "j06_inclusive_bins",
    """SELECT CASE WHEN l_quantity < 10 THEN 'a' WHEN l_quantity >= 10 AND l_quantity <= 20 THEN 'b' WHEN l_quantity > 20 AND l_quantity < 30 THEN 'c' WHEN l_quantity > 30 THEN 'd' END AS label, count(*) AS n FROM lineitem GROUP BY 1""",
)
def j06(spark, sf):
    """Containment that honours the inclusive flags; 30 lies in no bin."""
    hit = F.get(F.filter(B.bin_array(FLAGGED), lambda b: B.contains(b, F.col("l_quantity"))), F.lit(0))["label"]
    return table(spark, sf, "lineitem").groupBy(hit.alias("label")).agg(F.count("*").alias("n"))


GAPPED = [("lo", None, 5.0), ("p", 8.0, 8.0), ("mid", 12.0, 20.0), ("hi", 30.0, None)]


@query(
    "j07_bin_position",
    """WITH s AS (SELECT l_quantity AS x, count(*) AS n FROM lineitem GROUP BY 1),
    r AS (SELECT x, n, CASE WHEN x <= 5 THEN 0 WHEN x BETWEEN 7.5 AND 8.5 THEN 1 WHEN x BETWEEN 12 AND 20 THEN 2 WHEN x >= 30 THEN 3
      WHEN least(abs(x - 2.5), abs(x - 8), abs(x - 16), abs(x - 30)) = abs(x - 2.5) THEN 0 WHEN least(abs(x - 8), abs(x - 16), abs(x - 30)) = abs(x - 8) THEN 1 WHEN abs(x - 16) <= abs(x - 30) THEN 2 ELSE 3 END AS rank FROM s)
    SELECT x, n, rank::INT AS bin_rank, round(rank / 3.0::DOUBLE, 6) AS bin_rank_norm, rank = 0 AS is_lower_tail_bin, rank = 3 AS is_upper_tail_bin,
    CAST(CASE rank WHEN 0 THEN abs(5 - x) WHEN 1 THEN abs(x - 8) WHEN 2 THEN least(abs(x - 12), abs(20 - x)) ELSE abs(x - 30) END AS DOUBLE) AS bin_boundary_dist FROM r""",
)
def j07(spark, sf):
    """Matched or nearest bin with rank, tails and boundary distance."""
    s = table(spark, sf, "lineitem").groupBy(F.col("l_quantity").alias("x")).agg(F.count("*").alias("n"))
    out = s.withColumn("p", B.bin_position(B.bin_array(GAPPED), F.col("x"))).select("x", "n", "p.*").drop("n_bins")
    return rounded(out, "bin_rank_norm")


@query(
    "j07b_boundary_distance",
    """WITH s AS (SELECT l_quantity AS x, count(*) AS n FROM lineitem GROUP BY 1),
    r AS (SELECT x, n, CASE WHEN x < 5 THEN 0 WHEN x >= 7.5 AND x < 8.5 THEN 1 WHEN x >= 12 AND x < 20 THEN 2 WHEN x >= 30 THEN 3
      WHEN least(abs(x + 497), abs(x - 8), abs(x - 16), abs(x - 514.5)) = abs(x - 8) THEN 1 ELSE 2 END AS rank FROM s)
    SELECT x, n, CAST(CASE rank WHEN 0 THEN abs(5 - x) WHEN 1 THEN abs(x - 8) WHEN 2 THEN least(abs(x - 12), abs(20 - x)) ELSE abs(x - 30) END AS DOUBLE) AS dist FROM r""",
)
def j07b(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_quantity").alias("x")).agg(F.count("*").alias("n"))
    return s.withColumn("dist", B.boundary_distance(B.bin_array(GAPPED), F.col("x")))


ADJ_SQL = f"""{PR_SQL}, {MASS_SQL}, adj AS (SELECT *, coalesce(mean > upper, false) AS out, sum(prob) FILTER (NOT coalesce(mean > upper, false)) OVER (PARTITION BY rid) AS feasible FROM prob)"""


@query(
    "s26_observation_adjusted",
    with_roles("preds", f"WITH {ADJ_SQL} SELECT city, label, round(avg(CASE WHEN out THEN 0 ELSE prob / feasible END), 6) AS prob, count(*) FILTER (out) AS impossible, round(avg(greatest(1 - feasible, 0)), 6) AS removed_mass FROM adj GROUP BY ALL"),
)
def s26(spark, sf):
    """Bins below an observed maximum lose their mass, the others are scaled up."""
    bins = B.bin_array(BINS)
    p = probs(spark, sf).withColumn("a", B.observation_adjusted(bins, F.col("probs"), F.col("mean")))
    long = p.select("city", F.col("a.impossible").alias("gone"), F.col("a.removed_mass").alias("removed"), F.inline("a.probs"))
    return long.groupBy("city", "label").agg(
        F.round(F.avg("prob"), 6).alias("prob"),
        F.count(F.when(F.array_contains("gone", F.col("label")), 1)).alias("impossible"),
        F.round(F.avg("removed"), 6).alias("removed_mass"),
    )


@query(
    "a43_impossible_price_mass",
    with_roles("preds", f"WITH {PR_SQL}, {BINS_SQL}, i AS (SELECT rid, city, sum(CASE WHEN label <> '21' THEN 0.1 * (ordinal + 1) END) AS mass FROM pr, bins WHERE mean > upper GROUP BY ALL) SELECT city, count(mass) AS n, round(CAST(sum(mass) AS DOUBLE), 6) AS mass FROM i GROUP BY 1"),
)
def a43(spark, sf):
    """Best-ask mass still placed on impossible outcomes."""
    bins = B.bin_array(BINS)
    asks = F.transform(bins, lambda b, i: F.struct(b["label"].alias("label"), F.when(b["label"] != "21", 0.1 * (i + 1)).alias("ask")))
    gone = F.transform(F.filter(bins, lambda b: F.col("mean") > b["upper"]), lambda b: b["label"])
    p = roles.preds(spark, sf).withColumn("mass", B.impossible_price_mass(gone, asks)).where(F.size(gone) > 0)
    return p.groupBy("city").agg(F.count("mass").alias("n"), F.round(F.sum("mass"), 6).alias("mass"))


# --- scores ----------------------------------------------------------------------------


@query(
    "a29_brier",
    with_roles("preds", f"WITH {PR_SQL}, {MASS_SQL}, b AS (SELECT rid, any_value(city) AS city, avg(power(prob - CASE WHEN label = {WIN_SQL} THEN 1 ELSE 0 END, 2)) AS brier FROM prob GROUP BY rid) SELECT city, round(avg(brier), 6) AS brier FROM b GROUP BY 1"),
)
def a29(spark, sf):
    p = probs(spark, sf)
    return p.groupBy("city").agg(F.round(F.avg(B.brier(F.col("probs"), F.col("winner"))), 6).alias("brier"))


@query(
    "a29_brier_long",
    "SELECT o_custkey, round(avg(power(o_totalprice / 500000 - CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END, 2)), 6) AS brier FROM orders GROUP BY 1",
)
def a29l(spark, sf):
    """Brier per decision from long rows."""
    o = table(spark, sf, "orders").withColumn("p", F.col("o_totalprice") / 500000).withColumn("w", F.lit("1-URGENT"))
    return rounded(S.brier_rows(o, ["o_custkey"], "o_orderpriority", "p", "w"), "brier")


@query(
    "a30_calibration_error",
    """WITH s AS (SELECT lang, least(n_chars / 8000.0, 1.0)::DOUBLE AS p, quality AS y FROM documents JOIN labels USING (doc_id)),
    b AS (SELECT lang, CASE WHEN p < 1 THEN floor(p * 10) END AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM s GROUP BY ALL)
    SELECT lang, CAST(sum(n) AS BIGINT) AS n, round(coalesce(sum(CASE WHEN bin IS NOT NULL THEN n * abs(mp - my) END), 0) / sum(n), 6) AS calibration_error FROM b GROUP BY 1""",
)
def a30(spark, sf):
    """Ten-bin calibration error of a length score against the quality label."""
    s = table(spark, sf, "documents", ["doc_id", "lang", "n_chars"]).join(table(spark, sf, "labels"), "doc_id")
    s = s.withColumn("p", F.least(F.col("n_chars") / 8000.0, F.lit(1.0)))
    return rounded(S.calibration_error(s, "p", "quality", ["lang"]), "calibration_error")


CRPS_SQL = f"std * ((y - mean) / std * (2 * ({cdf_sql('(y - mean) / std')}) - 1) + 2 * exp(-((y - mean) / std) * ((y - mean) / std) / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))"
POINT_SQL = f"""count(*) AS n, round(avg(abs(y - mean)), 6) AS mae, round(sqrt(avg((y - mean) * (y - mean))), 6) AS rmse,
    round(avg(0.5 * ln(2 * pi() * std * std) + 0.5 * power((y - mean) / std, 2)), 6) AS nll, round(avg({CRPS_SQL}), 6) AS crps"""


@query("a31_point_scores", with_roles("preds", f"SELECT model_name, {POINT_SQL} FROM preds GROUP BY 1"))
def a31(spark, sf):
    return rounded(S.point_scores(roles.preds(spark, sf), "mean", "std", "y", ["model_name"]), "mae", "rmse", "nll", "crps")


@query(
    "a32_sample_crps",
    """WITH v AS (SELECT vec_id, label / 50.0 AS y, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
    SELECT vec_id, round(list_avg(list_transform(e, lambda x: abs(x - y))) - 0.5 * list_avg(flatten(list_transform(e, lambda a: list_transform(e, lambda b: abs(a - b))))), 6) AS crps FROM v""",
)
def a32(spark, sf):
    """CRPS of 64 samples by the sorted identity, checked against all pairs."""
    e = table(spark, sf, "embeddings").withColumn("s", F.transform("embedding", lambda v: v.cast("double")))
    return e.select("vec_id", F.round(N.sample_crps(F.col("s"), F.col("label") / 50.0), 6).alias("crps"))


@query("a33_gaussian_crps", with_roles("preds", f"SELECT city, round(avg({CRPS_SQL}), 8) AS crps FROM preds GROUP BY 1"))
def a33(spark, sf):
    scored = N.with_gaussian_crps(roles.preds(spark, sf), "mean", "std", "y")
    return scored.groupBy("city").agg(F.round(F.avg("crps"), 8).alias("crps"))


EVAL_SQL = f"""{PR_SQL}, {MASS_SQL}, r AS (SELECT rid, any_value(model_name) AS model_name, any_value(unit) AS unit, any_value(mean) AS mean, any_value(std) AS std, any_value(y) AS y, any_value({WIN_SQL}) AS winner,
    arg_max(label, (prob, -ordinal)) AS top, max(prob) AS p, avg(power(prob - CASE WHEN label = {WIN_SQL} THEN 1 ELSE 0 END, 2)) AS brier FROM prob GROUP BY rid),
  c AS (SELECT *, {CRPS_SQL} AS crps, CASE WHEN unit = 'F' THEN 5.0::DOUBLE / 9 ELSE 1 END AS k FROM r),
  e AS (SELECT model_name, sum(CASE WHEN bin IS NOT NULL THEN n * abs(mp - my) END) / sum(n) AS ece FROM (SELECT model_name, CASE WHEN p < 1 THEN floor(p * 10) END AS bin, count(*) AS n, avg(p) AS mp, avg(CAST(top = winner AS INT)) AS my FROM r GROUP BY ALL) GROUP BY 1)"""


@query(
    "a34_model_evaluation",
    with_roles(
        "preds",
        f"""WITH {EVAL_SQL} SELECT c.model_name, count(*) AS n, round(avg(abs(y - mean)), 6) AS mae_market_unit, round(avg(abs(y - mean) * k), 6) AS mae_c, round(avg(crps), 6) AS crps_market_unit, round(avg(crps * k), 6) AS crps_c,
    round(avg(brier), 6) AS brier, round(avg(CAST(top = winner AS INT)), 6) AS direction_accuracy, round(any_value(ece), 6) AS calibration_error FROM c JOIN e ON e.model_name = c.model_name GROUP BY 1""",
    ),
)
def a34(spark, sf):
    """Evaluation roll-up per model on common valid rows."""
    bins = B.bin_array(BINS)
    p = roles.preds(spark, sf).withColumn("winner", B.winning_label(bins, F.col("y")))
    out = S.evaluate(p, "mean", "std", "y", "unit", bins, "winner", ["model_name"])
    return rounded(out, *[c for c in out.columns if c not in ("model_name", "n")])


@query(
    "w16_top_outcomes",
    with_roles("preds", f"WITH {EVAL_SQL} SELECT top, count(*) AS n, round(avg(p), 6) AS p FROM r GROUP BY 1"),
)
def w16(spark, sf):
    p = probs(spark, sf).withColumn("t", B.top_outcome(F.col("probs")))
    return p.groupBy(F.col("t.label").alias("top")).agg(F.count("*").alias("n"), F.round(F.avg("t.prob"), 6).alias("p"))


@query(
    "x18_sample_evaluation",
    f"""WITH {BINS_SQL}, e AS (SELECT vec_id, label % 3 AS grp, label * 4.0 AS y, list_transform(embedding, lambda x: x::DOUBLE * 100 + 15) AS s FROM embeddings),
    v AS (SELECT vec_id, unnest(s) AS x FROM e), m AS (SELECT vec_id, b.ordinal, b.label, count(*) FILTER (x >= coalesce(b.lower - 0.5, -1e9) AND x < coalesce(b.upper + 0.5, 1e9)) / count(*) AS q FROM v, bins b GROUP BY ALL),
    n AS (SELECT *, q / sum(q) OVER (PARTITION BY vec_id) AS p FROM m),
    r AS (SELECT e.vec_id, grp, y, s, {WIN_SQL} AS winner, arg_max(n.label, (round(n.p, 9), -n.ordinal)) AS top, avg(power(p - CASE WHEN n.label = {WIN_SQL} THEN 1 ELSE 0 END, 2)) AS brier FROM e JOIN n USING (vec_id) GROUP BY ALL)
    SELECT grp, count(*) AS n, round(avg(abs(list_avg(s) - y)), 6) AS mae, round(avg(list_avg(list_transform(s, lambda a: abs(a - y))) - 0.5 * list_avg(flatten(list_transform(s, lambda a: list_transform(s, lambda b: abs(a - b)))))), 6) AS crps,
    round(avg(brier), 6) AS brier, round(avg(CAST(top = winner AS INT)), 6) AS direction_accuracy FROM r GROUP BY 1""",
)
def x18(spark, sf):
    """Evaluation of forecasts given as samples."""
    bins = B.bin_array(BINS)
    e = table(spark, sf, "embeddings").select(
        "vec_id", (F.col("label") % 3).alias("grp"), (F.col("label") * 4.0).alias("y"),
        F.transform("embedding", lambda v: v.cast("double") * 100 + 15).alias("s"),
    ).withColumn("winner", B.winning_label(bins, F.col("y")))
    out = S.evaluate_samples(e, "s", "y", bins, "winner", ["grp"]).drop("calibration_error")
    return rounded(out, "mae", "crps", "brier", "direction_accuracy")


SEED_SQL = """seeds AS (SELECT model_name, decision_horizon AS seed, avg(abs(y - mean)) AS mae, avg(std) AS spread, count(*) AS trades FROM preds GROUP BY ALL)"""


def seeds(spark, sf):
    return roles.preds(spark, sf).groupBy("model_name", F.col("decision_horizon").alias("seed")).agg(
        F.avg(F.abs(F.col("y") - F.col("mean"))).alias("mae"), F.avg("std").alias("spread"), F.count("*").alias("trades")
    )


@query(
    "a35_seed_summary",
    with_roles("preds", f"WITH {SEED_SQL} SELECT model_name, count(*) AS seeds, round(avg(mae), 6) AS mae_mean, round(avg(spread), 6) AS spread_mean, round(stddev_pop(mae), 6) AS mae_std, round(stddev_pop(spread), 6) AS spread_std, bool_and(trades >= 1000) AS sample_adequacy_passed FROM seeds GROUP BY 1"),
)
def a35(spark, sf):
    out = S.seed_summary(seeds(spark, sf), "model_name", ["mae", "spread"], 1000, "trades")
    return rounded(out, "mae_mean", "spread_mean", "mae_std", "spread_std")


@query(
    "a46_city_crps",
    with_roles("preds", f"SELECT city, country, count(*) AS n, round(avg({CRPS_SQL}), 6) AS crps, round(quantile_cont({CRPS_SQL}, 0.9), 6) AS p90 FROM preds GROUP BY ALL"),
)
def a46(spark, sf):
    """CRPS per city and country with the exact 90 % quantile."""
    from skyledger.operators.quantiles import with_quantiles

    p = N.with_gaussian_crps(roles.preds(spark, sf), "mean", "std", "y")
    out = p.groupBy("city", "country").agg(F.count("*").alias("n"), F.avg("crps").alias("mean_crps"))
    out = with_quantiles(out, p, ["city", "country"], "crps", {"p90": 0.9}).withColumnRenamed("mean_crps", "crps")
    return rounded(out, "crps", "p90")


@query(
    "a51_oracle_comparison",
    with_roles(
        "preds",
        """WITH t AS (SELECT city, abs(y - mean) AS a, abs(y - mean * 1.01) AS b, mean / 51.0 AS w FROM preds) SELECT city, count(*) AS n, round(avg(least(a, b)), 6) AS oracle_mean, round(avg(CAST(b < a AS INT)), 6) AS second_better_rate,
    round(avg(b - a), 6) AS mean_difference, round(avg(abs(b - a)), 6) AS mean_abs_difference, round(avg(CAST(w >= 0.5 AS INT)), 6) AS weight_share_half, round(quantile_cont(w, 0.1), 6) AS weight_p10, round(quantile_cont(w, 0.5), 6) AS weight_p50, round(quantile_cont(w, 0.9), 6) AS weight_p90 FROM t GROUP BY 1""",
    ),
)
def a51(spark, sf):
    p = roles.preds(spark, sf).withColumns(
        {"a": F.abs(F.col("y") - F.col("mean")), "b": F.abs(F.col("y") - F.col("mean") * 1.01), "w": F.col("mean") / 51.0}
    )
    out = S.oracle_comparison(p, "a", "b", "w", ["city"])
    return rounded(out, *[c for c in out.columns if c not in ("city", "n")])


@query(
    "a52_expert_diagnostics",
    with_roles(
        "preds",
        """WITH t AS (SELECT y, mean AS e1, mean + 1 AS e2, mean - 2 AS e3, 0.2 + std / 10 AS w1, 0.5 - std / 20 AS w2, 0.3 - std / 20 AS w3 FROM preds), d AS (SELECT *, abs(e1 - y) AS d1, abs(e2 - y) AS d2, abs(e3 - y) AS d3 FROM t)
    SELECT count(*) AS n, round(avg(d1), 6) AS e1_mae, round(avg(d2), 6) AS e2_mae, round(avg(d3), 6) AS e3_mae, round(avg(least(d1, d2, d3)), 6) AS best_expert_mae,
    round(avg(-w1 * ln(greatest(w1, 1e-6)) - w2 * ln(greatest(w2, 1e-6)) - w3 * ln(greatest(w3, 1e-6))), 6) AS gate_entropy,
    round(avg(CAST(CASE WHEN least(d1, d2, d3) = d1 THEN 1 WHEN least(d1, d2, d3) = d2 THEN 2 ELSE 3 END = CASE WHEN greatest(w1, w2, w3) = w1 THEN 1 WHEN greatest(w1, w2, w3) = w2 THEN 2 ELSE 3 END AS INT)), 6) AS gate_match_rate FROM d""",
    ),
)
def a52(spark, sf):
    m, s = F.col("mean"), F.col("std")
    p = roles.preds(spark, sf).withColumns({"e1": m, "e2": m + 1, "e3": m - 2, "w1": 0.2 + s / 10, "w2": 0.5 - s / 20, "w3": 0.3 - s / 20})
    out = S.expert_diagnostics(p, ["e1", "e2", "e3"], ["w1", "w2", "w3"], "y")
    return rounded(out, *[c for c in out.columns if c != "n"])


# --- leaderboards ------------------------------------------------------------------------

BOARD_SQL = """board AS (SELECT city AS model_name, round(avg(abs(y - mean)), 6) AS mae_mean, round(sqrt(avg((y - mean) * (y - mean))), 6) AS rmse_mean, round(avg(std), 6) AS avg_crps_mean, round(avg(mean), 6) AS real_history_pnl_mean, count(*) >= 2300 AS sample_adequacy_passed FROM preds GROUP BY 1)"""


def board(spark, sf):
    y, m = F.col("y"), F.col("mean")
    return roles.preds(spark, sf).groupBy(F.col("city").alias("model_name")).agg(
        F.round(F.avg(F.abs(y - m)), 6).alias("mae_mean"),
        F.round(F.sqrt(F.avg((y - m) * (y - m))), 6).alias("rmse_mean"),
        F.round(F.avg("std"), 6).alias("avg_crps_mean"),
        F.round(F.avg(m), 6).alias("real_history_pnl_mean"),
        (F.count("*") >= 2300).alias("sample_adequacy_passed"),
    )


@query(
    "w05_research_score",
    with_roles("preds", f"WITH {BOARD_SQL} SELECT model_name, round(0.25 * dense_rank() OVER (ORDER BY avg_crps_mean) + 0.15 * dense_rank() OVER (ORDER BY mae_mean) + 0.05 * dense_rank() OVER (ORDER BY rmse_mean) + 0.10 * dense_rank() OVER (ORDER BY real_history_pnl_mean DESC), 6)::DOUBLE AS champion_score FROM board"),
)
def w05(spark, sf):
    return S.score_leaderboard(board(spark, sf)).select("model_name", F.round("champion_score", 6).alias("champion_score"))


@query(
    "w05_execution_score",
    with_roles("preds", f"WITH {BOARD_SQL}, f AS (SELECT * FROM board WHERE sample_adequacy_passed OR NOT (SELECT bool_or(sample_adequacy_passed) FROM board)) SELECT model_name, round(0.1 * dense_rank() OVER (ORDER BY avg_crps_mean) + 0.05 * dense_rank() OVER (ORDER BY mae_mean) + 0.05 * dense_rank() OVER (ORDER BY rmse_mean) + 0.35 * dense_rank() OVER (ORDER BY real_history_pnl_mean DESC), 6)::DOUBLE AS execution_candidate_score FROM f"),
)
def w05e(spark, sf):
    return S.score_execution(board(spark, sf)).select("model_name", F.round("execution_candidate_score", 6).alias("execution_candidate_score"))


@query(
    "j15_leaderboard_scores",
    with_roles("preds", f"WITH {BOARD_SQL}, s AS (SELECT model_name, round(0.1 * dense_rank() OVER (ORDER BY avg_crps_mean) + 0.05 * dense_rank() OVER (ORDER BY mae_mean) + 0.05 * dense_rank() OVER (ORDER BY rmse_mean) + 0.35 * dense_rank() OVER (ORDER BY real_history_pnl_mean DESC), 6)::DOUBLE AS score FROM board WHERE sample_adequacy_passed) SELECT board.model_name, mae_mean, score FROM board LEFT JOIN s ON s.model_name = board.model_name"),
)
def j15(spark, sf):
    b = board(spark, sf)
    scored = S.score_execution(b).select("model_name", F.round("execution_candidate_score", 6).alias("score"))
    return b.select("model_name", "mae_mean").join(scored, "model_name", "left")


@query(
    "o08_beats_baseline",
    with_roles("preds", f"WITH {BOARD_SQL}, b AS (SELECT * FROM board ORDER BY model_name LIMIT 1) SELECT board.model_name, (round(board.mae_mean, 1), board.rmse_mean) < (round(b.mae_mean, 1), b.rmse_mean) AS better FROM board, b"),
)
def o08(spark, sf):
    """Lexicographic metric comparison with a baseline model."""
    b = board(spark, sf)
    base = b.orderBy("model_name").limit(1)
    out = b.withColumn("bm", base.select("mae_mean").scalar()).withColumn("br", base.select("rmse_mean").scalar())
    better = S.beats([F.round("mae_mean", 1), F.col("rmse_mean")], [F.round("bm", 1), F.col("br")])
    return out.select("model_name", better.alias("better"))


@query(
    "o11_guarded_choice",
    with_roles("preds", f"WITH {BOARD_SQL} SELECT model_name, mae_mean, avg_crps_mean FROM board WHERE mae_mean <= (SELECT min(mae_mean) FROM board) + 0.05 ORDER BY avg_crps_mean, mae_mean, model_name LIMIT 1"),
)
def o11(spark, sf):
    return S.guarded_choice(board(spark, sf), "mae_mean", "avg_crps_mean", 0.05, "model_name").select("model_name", "mae_mean", "avg_crps_mean")
