"""Queries of models, permutation tests, backtests and power."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.calendar import week_end
from marlstone.operators.events import abnormal_returns, decile_events, window_sums
from marlstone.operators.harness import bisected_n, permutation_p, simulated_power, smallest_detectable, spearman_permutation, walk_forward
from marlstone.operators.joins import trailing_join
from marlstone.operators.labels import decile_labels, last_value, momentum, recovery_weights, scar_flags, tail_labels, trailing_volatility, weekly
from marlstone.operators.metrics import metrics
from marlstone.operators.models import boosted_against_logit, grouped_logit, grouped_quantiles, pooled_logit, pooled_report, split_logit
from marlstone.operators.windows import along, running_sum
from marlstone.plans.prepare import settled
from marlstone.plans.series import R6, RET, r6, returns
from marlstone.plans.study import assets
from marlstone.session import durable

SPECS = {"all": ["rwdv", "semidev", "mom"], "vol": ["rwdv"], "mom": ["mom"]}


def features(spark: SparkSession, d: str) -> DataFrame:
    """Weekly feature table of the order series: labels, volatilities and momentum by asset."""
    x = assets(spark, d).select("asset", "d", "r")
    x = durable(x.withColumn("level", F.exp(running_sum(F.col("r"), along(["asset"], "d")))))
    vols = trailing_volatility(recovery_weights(x, "asset"), "asset").withColumn("week", week_end(F.col("d")))
    vols = vols.groupBy("asset", "week").agg(*[last_value(c).alias(c) for c in ("rwdv", "semidev")])
    labels = decile_labels(durable(scar_flags(x, "asset")), "asset")
    return labels.join(vols, ["asset", "week"], "left").join(momentum(x, "asset"), ["asset", "week"], "left").na.drop(subset=["rwdv", "mom"])


def m1_logit(spark: SparkSession, d: str) -> DataFrame:
    """Logit by asset with odds ratios per deviation (M1, M2, V7, V8)."""
    return grouped_logit(features(spark, d), ["asset"], "tail_down", ["rwdv", "mom"])


def m3_split(spark: SparkSession, d: str) -> DataFrame:
    """Logit before and from 1998 on, each in sample over all assets."""
    regime = F.when(F.col("week") < "1998-01-01", "early").otherwise("late")
    x = features(spark, d).select(regime.alias("regime"), F.col("tail_down").alias("y"), F.col("rwdv").alias("x1"), F.col("mom").alias("x2"))
    return pooled_report(durable(x), "regime", "y", ["x1", "x2"])


def m3_after(spark: SparkSession, d: str) -> DataFrame:
    """AUC from 1998 on of each asset's logit trained before (M3)."""
    return split_logit(features(spark, d), ["asset"], "week", "tail_down", ["rwdv", "mom"], "1998-01-01")


def m4_firth(spark: SparkSession, d: str) -> DataFrame:
    """Penalised logit by asset with likelihood-ratio p (M4, M5)."""
    return grouped_logit(features(spark, d), ["asset"], "tail_down", ["rwdv", "mom"], firth=True)


def m6_permutation(spark: SparkSession, d: str) -> DataFrame:
    """Label permutation p by asset."""
    return permutation_p(features(spark, d), ["asset"], "week", "tail_down", ["rwdv", "mom"], replicates=5000)


def m7_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The same by asset and regime, shuffling blocks of eight weeks."""
    x = features(spark, d)
    x = x.withColumn("regime", F.expr("CASE WHEN week < '1998-01-01' THEN 'early' ELSE 'late' END"))
    return permutation_p(x, ["asset", "regime"], "week", "tail_down", ["rwdv", "mom"], replicates=3000, block=8)


def m8_interaction(spark: SparkSession, d: str) -> DataFrame:
    """Pooled logit with a regime and its interaction with momentum."""
    late = (F.col("week") >= "1998-01-01").cast("double")
    x = features(spark, d).withColumns({"late": late, "mom_late": F.col("mom") * late})
    return pooled_logit(x, "tail_down", ["mom", "late", "mom_late", "rwdv"])


def m9_panel(spark: SparkSession, d: str) -> DataFrame:
    """Pooled logit with asset effects and errors clustered by asset and week."""
    return pooled_logit(features(spark, d), "tail_down", ["rwdv", "mom"], clusters=["asset", "week"], fixed_effects="asset")


def m10_ridge(spark: SparkSession, d: str) -> DataFrame:
    """Pooled logit with an L2 penalty, rows weighted by age."""
    x = features(spark, d)
    newest = x.agg(F.max("week")).collect()[0][0]
    x = x.withColumn("w", F.pow(F.lit(0.5), F.datediff(F.lit(newest), F.col("week")) / (7 * 104)))
    return pooled_logit(x, "tail_down", ["rwdv", "mom"], weight="w", ridge=1.0)


def m11_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return grouped_quantiles(features(spark, d), ["asset"], "ret_1w_fwd", ["rwdv", "mom"])


def m12_boosted(spark: SparkSession, d: str) -> DataFrame:
    return boosted_against_logit(features(spark, d), ["asset"], "week", "tail_up", ["rwdv", "semidev", "mom"], rounds=300)


def m13_spearman(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of the abnormal return around an event with the momentum before it."""
    x = durable(assets(spark, d))
    cars = window_sums(abnormal_returns(decile_events(x, "asset"), x, "asset"), "asset").filter("window = 'full'").select("asset", "sign", "ev_date", "car")
    before = trailing_join(cars, x.select("asset", "d", "r"), ["asset"], "ev_date", "d", 28, [F.avg("r").alias("before")])
    return spearman_permutation(before, ["sign"], "before", "car", replicates=20_000)


def d12_evt(spark: SparkSession, d: str) -> DataFrame:
    """Tail weeks by tail fits."""
    x = weekly(assets(spark, d), {"ret": F.sum("r")}, "asset", fill={"ret": 0.0})
    return tail_labels(x, "ret", "asset", method="evt")


def h1_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """One-step-ahead predictions for all specs and half-lives (H1 to H3)."""
    return walk_forward(features(spark, d), "asset", "week", SPECS, (26.0, 52.0, 104.0, 208.0, 1e9), known="known")


def h1_scores(spark: SparkSession, d: str) -> DataFrame:
    """Their metrics by spec and half-life (V9: against ``m1_logit``)."""
    return metrics(durable(h1_walk_forward(spark, d)), ["spec", "half_life"])


def h4_weights(spark: SparkSession, d: str) -> DataFrame:
    """Plain against balanced class weights."""
    x = durable(features(spark, d))
    parts = [metrics(durable(walk_forward(x, "asset", "week", {"all": SPECS["all"]}, balanced=b, known="known")), ["spec"]).withColumn("balanced", F.lit(b)) for b in (False, True)]
    return parts[0].unionByName(parts[1])


#: Event rate, rows of one series, replicates and grids of the power analysis.
RATE, WEEKS, POWER_REPS = 0.0659, 273, 600
POWER_SIZES = (100, 200, 273, 300, 500, 800, 1000, 1200, 2000, 3000, 5000)
ODDS_RATIOS = (1.3, 1.5, 1.7, 2.0)
MDE_GRID = tuple(round(1.1 + 0.1 * k, 1) for k in range(50))


def h5_power(spark: SparkSession, d: str) -> DataFrame:
    """Power of the Wald test over a grid of sizes and odds ratios."""
    return simulated_power(spark, [(n, RATE, o) for n in POWER_SIZES for o in ODDS_RATIOS], reps=POWER_REPS)


def h6_required(spark: SparkSession, d: str) -> DataFrame:
    """Smallest size up to 20,000 with 80 % power, by bisection, and smallest odds ratio of 1.1 to 6.0 that a size detects."""
    found = [("required_n", o, n) for o, n in bisected_n(spark, RATE, list(ODDS_RATIOS), reps=POWER_REPS)]
    found += [("detectable_or", n, o) for n, o in smallest_detectable(spark, RATE, [WEEKS, 500, 1000], list(MDE_GRID), reps=POWER_REPS)]
    return spark.createDataFrame([(what, float(at), None if v is None else float(v)) for what, at, v in found], "what string, at double, value double")


def h7_hsieh(spark: SparkSession, d: str) -> DataFrame:
    """Closed-form sample size by a coin's rate of loss days, and the design effect of its days."""
    x = returns(spark, d).filter("r is not null").groupBy("coin").agg(F.avg((F.col("r") < 0).cast("double")).alias("p"), F.count("*").alias("m")).filter("p > 0 and p < 1")
    z = F.lit(1.959964 + 0.841621)
    each = F.explode(F.array(*[F.lit(v) for v in (1.3, 1.5, 1.7, 2.0)])).alias("odds_ratio")
    return x.select("coin", "p", "m", each).select("coin", F.col("odds_ratio").cast("double").alias("odds_ratio"), *r6(required=z * z / (F.col("p") * (1 - F.col("p")) * F.pow(F.ln("odds_ratio"), F.lit(2))), design_effect=1 + (F.col("m") - 1) * 0.02))


def k3_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdict columns on pooled odds ratios: does the interval leave out one."""
    return m9_panel(spark, d).withColumn("excludes_one", (F.col("lo") > 1) | (F.col("hi") < 1)).select("feature", "excludes_one", settled(F.col("odds_ratio")).alias("odds_ratio"))


QUERIES = {f.__name__: f for f in (m1_logit, m3_split, m3_after, m4_firth, m6_permutation, m7_blocks, m8_interaction, m9_panel, m10_ridge, m11_quantiles, m12_boosted, m13_spearman, d12_evt, h1_walk_forward, h1_scores, h4_weights, h5_power, h6_required, h7_hsieh, k3_verdicts)}


SQL = {
    "h7_hsieh": f"WITH {RET}, q AS (SELECT coin, avg(CAST(r < 0 AS DOUBLE)) AS p, count(*) AS m FROM ret WHERE r IS NOT NULL GROUP BY coin) SELECT coin, CAST(o AS DOUBLE) AS odds_ratio, {R6('pow(1.959964 + 0.841621, 2) / (p * (1 - p) * pow(ln(o), 2))')} AS required, {R6('1 + (m - 1) * 0.02')} AS design_effect FROM q CROSS JOIN (VALUES (1.3::DOUBLE), (1.5::DOUBLE), (1.7::DOUBLE), (2.0::DOUBLE)) v(o) WHERE p > 0 AND p < 1",
}
