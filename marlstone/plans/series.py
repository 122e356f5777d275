"""Queries of windows, resampling, features and labels on the price panel, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from marlstone.functions.calendar import month_end, week_end
from marlstone.operators.labels import decile_labels, tail_labels, last_value, momentum, monthly_forward, normalised, recovery_weights, scar_flags, trailing_volatility, weekly, with_returns
from marlstone.operators.trailing import latest_readings
from marlstone.operators.windows import along, average_rank, forward_fill, gap_clusters, rolling, rolling_weighted_mean, running_product, running_sum, top_k
from marlstone.plans.prepare import settled
from marlstone.session import durable
from marlstone.sources.tables import table


def prices(spark: SparkSession, d: str) -> DataFrame:
    """Clean daily levels: ``coin``, ``d``, ``level``; the latest loaded row of a day, positive levels only."""
    clean = latest_readings(table(spark, d, "panel_prices"), "coin", "date", ["close"], "loaded_at")
    return clean.filter("__v0 > 0").select(F.col("__e").alias("coin"), F.col("__day").alias("d"), F.col("__v0").alias("level"))


def sentiment(spark: SparkSession, d: str) -> DataFrame:
    """Clean weekly sentiment: ``coin``, ``week`` (as written), ``n``, ``s``."""
    clean = latest_readings(table(spark, d, "sentiment_weekly"), "coin", "week", ["n_articles", "finbert_exp_hl7"], "loaded_at")
    return clean.select(F.col("__e").alias("coin"), F.col("__day").alias("week"), F.col("__v0").alias("n"), F.col("__v1").alias("s"))


def returns(spark: SparkSession, d: str) -> DataFrame:
    return with_returns(prices(spark, d))


def flags(spark: SparkSession, d: str) -> DataFrame:
    """Weekly scar flags of all coins. They feed cuts, labels and joins several times, so the panel is read and cut once."""
    return durable(scar_flags(durable(returns(spark, d))))


def r6(**columns: Column) -> list[Column]:
    return [settled(c).alias(n) for n, c in columns.items()]


def by_day() -> WindowSpec:
    return along(["coin"], "d")


PX = "px AS (SELECT coin, date AS d, arg_max(close, (loaded_at, close)) AS level FROM panel_prices WHERE close IS NOT NULL AND coin IS NOT NULL AND date IS NOT NULL GROUP BY coin, date HAVING arg_max(close, (loaded_at, close)) > 0)"
RET = PX + ", ret AS (SELECT coin, d, level, ln(level) - lag(ln(level)) OVER (PARTITION BY coin ORDER BY d) AS r FROM px)"
SENT = "se AS (SELECT coin, week, arg_max(CAST(n_articles AS DOUBLE), (loaded_at, n_articles)) AS n, arg_max(coalesce(finbert_exp_hl7, 'NaN'::DOUBLE), (loaded_at, n_articles)) AS s0 FROM sentiment_weekly WHERE n_articles IS NOT NULL AND coin IS NOT NULL AND week IS NOT NULL GROUP BY coin, week), sen AS (SELECT coin, week, n, CASE WHEN isnan(s0) THEN NULL ELSE s0 END AS s FROM se)"
FRI = lambda x: f"CAST({x} + CAST((5 - dayofweek({x}) + 7) % 7 AS INTEGER) AS DATE)"
R6 = lambda x: f"round({x} + 2e-9, 6)"


def roll(agg: str, x: str, n: int, need: int | None = None, order: str = "d") -> str:
    w = f"OVER (PARTITION BY coin ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= {need or n} THEN {agg}({x}) {w} END"


WEEKS = RET + f""",
wk0 AS (SELECT coin, {FRI("d")} AS week, coalesce(sum(r), 0) AS ret, arg_max(level, d) AS last_level, count(*) AS n_obs FROM ret GROUP BY ALL),
cal AS (SELECT coin, CAST(unnest(generate_series(min(week)::TIMESTAMP, max(week)::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS week FROM wk0 GROUP BY coin),
wk AS (SELECT coin, week, coalesce(ret, 0) AS ret, last_level, coalesce(n_obs, 0) AS n_obs FROM cal LEFT JOIN wk0 USING (coin, week))"""
SCAR = WEEKS + f""",
m AS (SELECT *, {FRI("d")} AS fri, lag(d) OVER (PARTITION BY coin ORDER BY d) AS pd,
       max(level) OVER (PARTITION BY coin ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING) AS best, count(level) OVER (PARTITION BY coin ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING) AS remaining FROM ret),
seg AS (SELECT coin, CAST(fri - 7 AS DATE) AS week, min(level) AS low, arg_min(coalesce(best, -1), (level, d)) AS best, arg_min(remaining, (level, d)) AS remaining FROM m
        WHERE NOT coalesce({FRI("pd")} < fri AND pd <> fri - 7, FALSE) GROUP BY ALL),
nx AS (SELECT *, lead(ret) OVER (PARTITION BY coin ORDER BY week) AS fwd FROM wk),
fl AS (SELECT coin, week, ret, fwd, coalesce(low < last_level, FALSE) AS fell, coalesce(best >= low + 0.5 * (last_level - low), FALSE) AS regained, remaining FROM nx LEFT JOIN seg USING (coin, week) WHERE fwd IS NOT NULL),
cut AS (SELECT coin, quantile_cont(ret, 0.1) AS lo, quantile_cont(ret, 0.9) AS hi FROM wk GROUP BY coin),
lab AS (SELECT coin, week, ret, fwd, fell AND NOT regained AS scar, NOT fell OR regained OR coalesce(remaining >= 15, FALSE) AS resolved,
  CAST(fwd <= lo AND fell AND NOT regained AS INTEGER) AS tail_down, CAST(fwd >= hi AS INTEGER) AS tail_up, CAST(fwd <= lo AS INTEGER) AS cand_down FROM fl JOIN cut USING (coin))"""
RWDV = RET + """,
rw AS (SELECT *, lag(level) OVER w AS p, list(level) OVER (PARTITION BY coin ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS ahead FROM ret WINDOW w AS (PARTITION BY coin ORDER BY d)),
rx AS (SELECT coin, d, level, r, CASE WHEN level < p THEN coalesce(nullif(list_position(list_transform(ahead, lambda x: x >= level + 0.5 * (p - level)), TRUE), 0), 10) / 10.0 ELSE 0.0 END AS w FROM rw),
ry AS (SELECT *, CASE WHEN r IS NOT NULL THEN pow(least(r, 0), 2) END AS down FROM rx),
rz AS (SELECT *, lag(down * w, 10) OVER (PARTITION BY coin ORDER BY d) AS late FROM ry)"""
VOL = f"SELECT coin, d, w, sqrt(365 * {roll('avg', 'late', 63)}) AS rwdv, sqrt(365 * {roll('avg', 'down', 63)}) AS semidev, {roll('stddev_samp', 'r', 63)} * sqrt(365) AS sd FROM rz"


# ---- windows -------------------------------------------------------------------------------------------------


def w3_lags(spark: SparkSession, d: str) -> DataFrame:
    """Daily log return and row lags."""
    x = returns(spark, d)
    return x.select("coin", "d", *r6(r=F.col("r"), lag1=F.lag("r", 1).over(by_day()), lag5=F.lag("r", 5).over(by_day())))


def w4_lead(spark: SparkSession, d: str) -> DataFrame:
    """Sum of the next 63 daily returns, and the return delayed by ten rows."""
    x = returns(spark, d).withColumn("s", rolling("sum", F.col("r"), by_day(), 63))
    return x.select("coin", "d", *r6(fwd63=F.lead("s", 63).over(by_day()), delayed=F.lag("r", 10).over(by_day())))


def w7_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Guarded rolling sum, mean and deviation."""
    x = returns(spark, d)
    return x.select("coin", "d", *r6(sum20=rolling("sum", F.col("r"), by_day(), 20), mean63=rolling("avg", F.col("r"), by_day(), 63), sd63=rolling("stddev_samp", F.col("r"), by_day(), 63)))


def w8_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Trailing four-row article-weighted sentiment, at least two rows."""
    w = along(["coin"], "week")
    return sentiment(spark, d).select("coin", "week", *r6(s4w=rolling_weighted_mean(F.col("s"), F.col("n"), w), log_volume=F.log1p("n")))


def w9_cumulative(spark: SparkSession, d: str) -> DataFrame:
    """Index level as exp of cumulated returns, and as cumulated growth of the same numbers."""
    x = returns(spark, d)
    return x.select("coin", "d", *r6(index_log=F.exp(running_sum(F.col("r"), by_day())), index_simple=running_product(F.col("r"), by_day())))


def w1_weekly(spark: SparkSession, d: str) -> DataFrame:
    """Weeks ending on a Friday: summed and compounded return, last level, rows; empty weeks materialised."""
    aggs = {"ret_sum": F.sum("r"), "ret_prod": F.exp(F.sum(F.log1p("r"))), "last_level": last_value("level"), "n_obs": F.count("*")}
    x = weekly(returns(spark, d), aggs, fill={"ret_sum": 0.0, "ret_prod": 1.0, "n_obs": 0})
    return x.select("coin", "week", "n_obs", *r6(ret_sum=F.coalesce("ret_sum", F.lit(0.0)), ret_prod=F.coalesce("ret_prod", F.lit(1.0)), last_level=F.col("last_level")))


def w2_month_last(spark: SparkSession, d: str) -> DataFrame:
    """Last level of each month."""
    x = prices(spark, d).groupBy("coin", month_end(F.col("d")).alias("month_end")).agg(last_value("level").alias("v"))
    return x.select("coin", "month_end", *r6(last_level=F.col("v")))


def w10_ffill(spark: SparkSession, d: str) -> DataFrame:
    x = weekly(prices(spark, d), {"last_level": last_value("level")})
    return x.select("coin", "week", *r6(level=forward_fill(F.col("last_level"), along(["coin"], "week"))))


def w11_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Decile weeks merged into clusters by gaps of at most 30 days; the worst week of each."""
    x = decile_labels(flags(spark, d)).filter("cand_down = 1")
    c = gap_clusters(x, ["coin"], "week", 30)
    worst = F.min(F.struct("ret_1w_fwd", "week")).alias("b")
    return c.groupBy("coin", "cluster_id").agg(worst, F.count("*").alias("weeks")).select("coin", "cluster_id", "weeks", F.col("b.week").alias("week"), *r6(ret_1w_fwd=F.col("b.ret_1w_fwd")))


def w12_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Average-tie ranks of articles a week."""
    return sentiment(spark, d).select("coin", "week", average_rank(F.col("n"), ["coin"]).alias("avg_rank"))


def w14_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Peak of the last 31 rows and low from 7 rows back to 29 ahead."""
    return prices(spark, d).select("coin", "d", *r6(peak=F.max("level").over(by_day().rowsBetween(-30, 0)), low=F.min("level").over(by_day().rowsBetween(-7, 29))))


def w15_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three largest weekly article counts of each coin."""
    return top_k(sentiment(spark, d), ["coin"], [F.desc("n"), F.asc("week")], 3).select("coin", "week", "n")


def w16_expanding(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of all rows before the current one."""
    before = by_day().rowsBetween(Window.unboundedPreceding, -1)
    x = returns(spark, d)
    return x.select("coin", "d", *r6(mean_before=F.avg("r").over(before), sd_before=F.stddev_samp("r").over(before)))


# ---- features and labels ---------------------------------------------------------------------------------------


def d1_portfolio(spark: SparkSession, d: str) -> DataFrame:
    """Equal-weight portfolio: mean of the log returns of the coins that have one that day, two at least."""
    x = returns(spark, d).groupBy("d").agg(F.avg("r").alias("p"), F.count("r").alias("coins")).filter("coins >= 2")
    return x.select("d", "coins", *r6(portfolio=F.col("p")))


def d3_rwdv(spark: SparkSession, d: str) -> DataFrame:
    """Recovery weights and trailing volatilities."""
    x = trailing_volatility(recovery_weights(returns(spark, d)))
    return x.select("coin", "d", "w", *r6(rwdv=F.col("rwdv"), semidev=F.col("semidev"), sd=F.col("sd")))


def d5_labels(spark: SparkSession, d: str) -> DataFrame:
    """Weekly scar flags and decile labels."""
    x = decile_labels(flags(spark, d))
    return x.select("coin", "week", "scar", "resolved", "tail_down", "tail_up", "cand_down", *r6(ret_1w=F.col("ret_1w"), ret_1w_fwd=F.col("ret_1w_fwd")))


def d7_momentum(spark: SparkSession, d: str) -> DataFrame:
    return momentum(returns(spark, d)).select("coin", "week", *r6(mom=F.col("mom")))


def weekly_features(spark: SparkSession, d: str) -> DataFrame:
    """Labels with the week's last volatilities and momentum; rows without volatility or outcome dropped."""
    x = durable(returns(spark, d))
    labels = decile_labels(durable(scar_flags(x)))
    vols = trailing_volatility(recovery_weights(x)).withColumn("week", week_end(F.col("d")))
    vols = vols.groupBy("coin", "week").agg(*[last_value(c).alias(c) for c in ("rwdv", "semidev", "sd")])
    return labels.join(vols, ["coin", "week"], "left").join(momentum(x), ["coin", "week"], "left").na.drop(subset=["rwdv", "ret_1w_fwd"])


def d8_features(spark: SparkSession, d: str) -> DataFrame:
    f = weekly_features(spark, d)
    return f.select("coin", "week", "tail_down", "tail_up", "cand_down", *r6(**{c: F.col(c) for c in ("ret_1w", "ret_1w_fwd", "rwdv", "semidev", "sd", "mom")}))


def d9_forward(spark: SparkSession, d: str) -> DataFrame:
    return monthly_forward(returns(spark, d)).select("coin", "month_end", *r6(forward_return=F.col("forward_return")))


def d10_quantile(spark: SparkSession, d: str) -> DataFrame:
    """Weekly returns labelled by their coin's outer quantiles (6 % a side, inclusive)."""
    x = tail_labels(weekly(returns(spark, d), {"ret": F.sum("r")}, fill={"ret": 0.0}), "ret")
    return x.select("coin", "week", "tail_label", *r6(z=F.col("forward_zscore")))


def d11_global_z(spark: SparkSession, d: str) -> DataFrame:
    x = tail_labels(weekly(returns(spark, d), {"ret": F.sum("r")}, fill={"ret": 0.0}), "ret", method="global_z")
    return x.select("coin", "week", "tail_label", *r6(z=F.col("forward_zscore")))


def d18_momentum(spark: SparkSession, d: str) -> DataFrame:
    """One- and four-week momentum."""
    w = along(["coin"], "week")
    x = weekly(returns(spark, d), {"ret": F.sum("r")}, fill={"ret": 0.0})
    return x.select("coin", "week", *r6(mom1=F.col("ret"), mom4=rolling("sum", F.col("ret"), w, 4)))


def d19_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Series of at least 200 rows, relative to their first level."""
    return normalised(prices(spark, d)).select("coin", "d", *r6(rel=F.col("rel")))


def d20_panel(spark: SparkSession, d: str) -> DataFrame:
    """Pooled panel: weekly labels with the coin's own sentiment of the week and the mean over all coins."""
    own = sentiment(spark, d).groupBy("coin", week_end(F.col("week")).alias("week")).agg(F.avg("s").alias("own"), F.sum("n").alias("n"))
    shared = own.groupBy("week").agg(F.avg("own").alias("shared"))
    x = decile_labels(flags(spark, d)).select("coin", "week", "tail_down")
    return x.join(own, ["coin", "week"], "left").join(shared, "week", "left").select("coin", "week", "tail_down", "n", *r6(own=F.col("own"), shared=F.col("shared")))


def a13_base_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of tail weeks by coin, and whether it lies within 5 to 15 %."""
    x = decile_labels(flags(spark, d))
    rate = F.count_if(F.col("tail_down") == 1) / F.count("*")
    return x.groupBy("coin").agg(F.count("*").alias("weeks"), settled(rate).alias("base_rate"), rate.between(0.05, 0.15).alias("in_band"))


def s8_periods(spark: SparkSession, d: str) -> DataFrame:
    """Half-open months and quarters covering the panel."""
    b = prices(spark, d).agg(F.min("d").alias("a"), F.max("d").alias("b"))
    month = lambda n: F.transform(F.sequence(F.trunc("a", "month"), F.col("b"), F.expr(f"interval {n} month")), lambda x: F.struct(F.lit(n).alias("months"), x.alias("first"), F.add_months(x, n).alias("next")))
    return b.select(F.inline(F.concat(month(1), month(3))))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return d5_labels(spark, d)


_C = "PARTITION BY coin ORDER BY"
QUERIES = {f.__name__: f for f in (
    w1_weekly, w2_month_last, w3_lags, w4_lead, w7_rolling, w8_weighted, w9_cumulative, w10_ffill, w11_clusters, w12_ranks, w14_peaks, w15_topk, w16_expanding,
    d1_portfolio, d3_rwdv, d5_labels, d7_momentum, d8_features, d9_forward, d10_quantile, d11_global_z, d18_momentum, d19_normalised, d20_panel, a13_base_rate, s8_periods,
)}
_MOM = WEEKS + f""", md AS (SELECT coin, d, {roll("sum", "r", 20)} AS m FROM ret), mw AS (SELECT coin, {FRI("d")} AS week, arg_max(m, d) FILTER (WHERE m IS NOT NULL) AS m FROM md GROUP BY ALL),
mm AS (SELECT coin, week, last_value(m IGNORE NULLS) OVER ({_C} week) AS mom FROM cal LEFT JOIN mw USING (coin, week))"""
_LABEL = "st AS (SELECT coin, avg(ret) AS mu, stddev_samp(ret) AS sd, quantile_cont(ret, 0.06) AS lo, quantile_cont(ret, 0.94) AS hi FROM wk GROUP BY coin), zz AS (SELECT *, (ret - mu) / nullif(sd, 0) AS z FROM wk JOIN st USING (coin))"
SQL = {
    "w1_weekly": f"WITH {WEEKS}, pr AS (SELECT coin, {FRI('d')} AS week, exp(sum(ln(1 + r))) AS p FROM ret GROUP BY ALL) SELECT coin, week, n_obs, {R6('ret')} AS ret_sum, {R6('coalesce(p, 1)')} AS ret_prod, {R6('last_level')} AS last_level FROM wk LEFT JOIN pr USING (coin, week)",
    "w2_month_last": f"WITH {PX} SELECT coin, last_day(d) AS month_end, {R6('arg_max(level, d)')} AS last_level FROM px GROUP BY ALL",
    "w3_lags": f"WITH {RET} SELECT coin, d, {R6('r')} AS r, {R6(f'lag(r, 1) OVER ({_C} d)')} AS lag1, {R6(f'lag(r, 5) OVER ({_C} d)')} AS lag5 FROM ret",
    "w4_lead": f"WITH {RET}, s AS (SELECT *, {roll('sum', 'r', 63)} AS s FROM ret) SELECT coin, d, {R6(f'lead(s, 63) OVER ({_C} d)')} AS fwd63, {R6(f'lag(r, 10) OVER ({_C} d)')} AS delayed FROM s",
    "w7_rolling": f"WITH {RET} SELECT coin, d, {R6(roll('sum', 'r', 20))} AS sum20, {R6(roll('avg', 'r', 63))} AS mean63, {R6(roll('stddev_samp', 'r', 63))} AS sd63 FROM ret",
    "w8_weighted": f"WITH {SENT} SELECT coin, week, {R6('(' + roll('sum', 's * n', 4, 2, 'week') + ') / (' + roll('sum', 'n', 4, 2, 'week') + ')')} AS s4w, {R6('ln(1 + n)')} AS log_volume FROM sen",
    "w9_cumulative": f"WITH {RET} SELECT coin, d, {R6(f'exp(sum(r) OVER ({_C} d))')} AS index_log, {R6(f'exp(sum(ln(1 + r)) OVER ({_C} d))')} AS index_simple FROM ret",
    "w10_ffill": f"WITH {WEEKS} SELECT coin, week, {R6(f'last_value(last_level IGNORE NULLS) OVER ({_C} week)')} AS level FROM wk",
    "w11_clusters": f"WITH {SCAR}, c AS (SELECT *, CASE WHEN week - lag(week) OVER ({_C} week) <= 30 THEN 0 ELSE 1 END AS fresh FROM lab WHERE cand_down = 1), e AS (SELECT *, sum(fresh) OVER ({_C} week) AS cluster_id FROM c) SELECT coin, CAST(cluster_id AS BIGINT) AS cluster_id, count(*) AS weeks, arg_min(week, (fwd, week)) AS week, {R6('min(fwd)')} AS ret_1w_fwd FROM e GROUP BY ALL",
    "w12_ranks": f"WITH {SENT} SELECT coin, week, rank() OVER ({_C} n) + (count(*) OVER (PARTITION BY coin, n) - 1) / 2.0 AS avg_rank FROM sen",
    "w14_peaks": f"WITH {PX} SELECT coin, d, {R6(f'max(level) OVER ({_C} d ROWS BETWEEN 30 PRECEDING AND CURRENT ROW)')} AS peak, {R6(f'min(level) OVER ({_C} d ROWS BETWEEN 7 PRECEDING AND 29 FOLLOWING)')} AS low FROM px",
    "w15_topk": f"WITH {SENT} SELECT coin, week, n FROM sen QUALIFY row_number() OVER (PARTITION BY coin ORDER BY n DESC, week) <= 3",
    "w16_expanding": f"WITH {RET} SELECT coin, d, {R6(f'avg(r) OVER ({_C} d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)')} AS mean_before, {R6(f'stddev_samp(r) OVER ({_C} d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)')} AS sd_before FROM ret",
    "d1_portfolio": f"WITH {RET} SELECT d, count(r) AS coins, {R6('avg(r)')} AS portfolio FROM ret GROUP BY d HAVING count(r) >= 2",
    "d3_rwdv": f"WITH {RWDV} SELECT coin, d, CAST(w AS DOUBLE) AS w, {R6('rwdv')} AS rwdv, {R6('semidev')} AS semidev, {R6('sd')} AS sd FROM ({VOL})",
    "d5_labels": f"WITH {SCAR} SELECT coin, week, scar, resolved, tail_down, tail_up, cand_down, {R6('ret')} AS ret_1w, {R6('fwd')} AS ret_1w_fwd FROM lab",
    "d7_momentum": f"WITH {_MOM} SELECT coin, week, {R6('mom')} AS mom FROM mm",
    "d8_features": f"WITH {_MOM}, {SCAR.split('AS n_obs FROM cal LEFT JOIN wk0 USING (coin, week)),')[-1].lstrip()}, {RWDV.split('FROM px),')[-1].lstrip()}, vv AS ({VOL}), vw AS (SELECT coin, {FRI('d')} AS week, arg_max(rwdv, d) FILTER (WHERE rwdv IS NOT NULL) AS rwdv, arg_max(semidev, d) FILTER (WHERE semidev IS NOT NULL) AS semidev, arg_max(sd, d) FILTER (WHERE sd IS NOT NULL) AS sd FROM vv GROUP BY ALL) SELECT coin, week, tail_down, tail_up, cand_down, {R6('ret')} AS ret_1w, {R6('fwd')} AS ret_1w_fwd, {R6('rwdv')} AS rwdv, {R6('semidev')} AS semidev, {R6('sd')} AS sd, {R6('mom')} AS mom FROM lab LEFT JOIN vw USING (coin, week) LEFT JOIN mm USING (coin, week) WHERE rwdv IS NOT NULL",
    "d9_forward": f"WITH {RET}, s AS (SELECT *, {roll('sum', 'r', 63)} AS s FROM ret), f AS (SELECT *, lead(s, 63) OVER ({_C} d) AS f FROM s) SELECT coin, last_day(d) AS month_end, {R6('arg_max(f, d)')} AS forward_return FROM f WHERE f IS NOT NULL GROUP BY ALL",
    "d10_quantile": f"WITH {WEEKS}, {_LABEL} SELECT coin, week, CASE WHEN ret >= hi THEN 1 WHEN ret <= lo THEN -1 ELSE 0 END AS tail_label, {R6('z')} AS z FROM zz",
    "d11_global_z": f"WITH {WEEKS}, {_LABEL} SELECT coin, week, CASE WHEN z > 2 THEN 1 WHEN z < -2 THEN -1 ELSE 0 END AS tail_label, {R6('z')} AS z FROM zz",
    "d18_momentum": f"WITH {WEEKS} SELECT coin, week, {R6('ret')} AS mom1, {R6(roll('sum', 'ret', 4, None, 'week'))} AS mom4 FROM wk",
    "d19_normalised": f"WITH {PX} SELECT coin, d, {R6('level / f')} AS rel FROM (SELECT *, count(*) OVER (PARTITION BY coin) AS n, first_value(level) OVER ({_C} d) AS f FROM px) WHERE n >= 200",
    "d20_panel": f"WITH {SCAR}, {SENT}, ow AS (SELECT coin, {FRI('week')} AS week, avg(s) AS own, sum(n) AS n FROM sen GROUP BY ALL), sh AS (SELECT week, avg(own) AS shared FROM ow GROUP BY week) SELECT coin, week, tail_down, n, {R6('own')} AS own, {R6('shared')} AS shared FROM lab LEFT JOIN ow USING (coin, week) LEFT JOIN sh USING (week)",
    "a13_base_rate": f"WITH {SCAR} SELECT coin, count(*) AS weeks, {R6('avg(tail_down)')} AS base_rate, avg(tail_down) BETWEEN 0.05 AND 0.15 AS in_band FROM lab GROUP BY coin",
    "s8_periods": f"WITH {PX}, b AS (SELECT min(d) AS a, max(d) AS b FROM px) " + " UNION ALL ".join(f"SELECT {n} AS months, CAST(x AS DATE) AS first, CAST(x + INTERVAL {n} MONTH AS DATE) AS next FROM (SELECT unnest(generate_series(date_trunc('month', a)::TIMESTAMP, b::TIMESTAMP, INTERVAL {n} MONTH)) AS x FROM b)" for n in (1, 3)),
}
