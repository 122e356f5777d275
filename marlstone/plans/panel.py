"""Models of the coin panel: sentiment and news volume against tail labels, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.calendar import week_end
from marlstone.operators.harness import walk_forward
from marlstone.operators.labels import decile_labels, last_value, momentum, recovery_weights, scar_flags, trailing_volatility
from marlstone.operators.metrics import metrics
from marlstone.operators.models import pooled_fits, pooled_logit, pooled_report, predicted
from marlstone.operators.windows import along, rolling_weighted_mean, running_sum
from marlstone.plans.series import FRI, R6, SCAR, SENT, r6, returns, roll, sentiment
from marlstone.session import durable

#: Training ends and test begins with this day; the late regime begins with it too.
SPLIT = "2024-01-01"
#: Features of the univariate specifications and the rows they are delayed by.
SINGLE, LAGS = ("s4w", "volume", "shared4"), (0, 1)


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Weekly labels of every coin on its spine, with trailing four-week sentiment (its own and that of all coins) and log news volume."""
    own = sentiment(spark, d).groupBy("coin", week_end(F.col("week")).alias("week")).agg(F.avg("s").alias("own"), F.sum("n").alias("n"))
    own = durable(own)
    shared = own.groupBy("week").agg(F.avg("own").alias("shared"))
    labels = decile_labels(durable(scar_flags(durable(returns(spark, d)))))
    x = labels.join(own, ["coin", "week"], "left").join(shared, "week", "left")
    w = along(["coin"], "week")
    x = x.withColumns({"s4w": rolling_weighted_mean(F.col("own"), F.col("n"), w), "shared4": rolling_weighted_mean(F.col("shared"), F.col("n"), w), "volume": F.log1p("n")})
    return durable(x.select("coin", "week", "tail_down", "ret_1w", "s4w", "shared4", "volume", *[F.lag(c).over(w).alias(f"{c}_1") for c in SINGLE]))


def _specs(x: DataFrame, specs: dict[str, list[str]]) -> DataFrame:
    """Rows of every specification under its name, its features as x1, x2 ..."""
    made = F.explode(F.array(*[F.struct(F.lit(name).alias("spec"), *[F.col(c).alias(f"x{k}") for k, c in enumerate(columns, start=1)]) for name, columns in specs.items()])).alias("__s")
    return x.select("coin", "week", F.col("tail_down").alias("y"), made).select("coin", "week", "y", "__s.*")


def _settled_when(c: str) -> Column:
    """Six digits of fits that came to rest, else NULL."""
    return r6(**{c: F.when(F.col("converged"), F.col(c))})[0]


_SINGLES = {f"{c}_lag{k}": [c if k == 0 else f"{c}_{k}"] for c in SINGLE for k in LAGS}


def m1_sentiment(spark: SparkSession, d: str) -> DataFrame:
    """Univariate logits of the tail label, specifications by lag: odds ratio, z, AUC, McFadden (M1, V7, V8)."""
    t = pooled_report(_specs(panel(spark, d), _SINGLES), "spec", "y", ["x1"])
    return t.select("spec", "n", "events", "converged", *[_settled_when(c) for c in ("odds_ratio", "z", "auc", "mcfadden")])


def m2_sentiment(spark: SparkSession, d: str) -> DataFrame:
    """Logit on sentiment and news volume together (M2)."""
    t = pooled_report(_specs(panel(spark, d), {"c0": ["s4w", "volume"]}), "spec", "y", ["x1", "x2"])
    return t.select("spec", "feature", "n", "events", "converged", *[_settled_when(c) for c in ("odds_ratio", "z", "auc", "mcfadden")])


def m3_sentiment(spark: SparkSession, d: str) -> DataFrame:
    """AUC after a day of the logit trained before it and scaled by the training rows' moments (M3)."""
    x = durable(_specs(panel(spark, d), {"s1": ["s4w", "volume"]}))
    fits = pooled_fits(x.filter(F.col("week") < SPLIT), "spec", "y", ["x1", "x2"])
    late = x.filter(F.col("week") >= SPLIT).na.drop()
    scored = metrics(predicted(late, "spec", ["x1", "x2"], fits), ["spec"])
    known = spark.createDataFrame([(g, f["n"], f["events"], f["converged"]) for g, f in fits.items()], "spec string, n_train bigint, events_train bigint, converged boolean")
    return known.join(scored, "spec").select("spec", "n_train", "events_train", F.col("n").alias("n_test"), F.col("events").alias("events_test"), "converged", *[_settled_when(c) for c in ("auc", "brier")])


def m4_sentiment(spark: SparkSession, d: str) -> DataFrame:
    """Penalised logit with the likelihood-ratio statistic of each coefficient, held at zero under the full penalty (M4, M5)."""
    x = durable(_specs(panel(spark, d), {"c0": ["s4w", "volume"]}))
    full = pooled_fits(x, "spec", "y", ["x1", "x2"], firth=True)
    rows = []
    for j, name in ((1, "s4w"), (2, "volume")):
        null = pooled_fits(x, "spec", "y", ["x1", "x2"], firth=True, fixed=j)
        rows += [(name, f["n"], f["events"], f["converged"] and null[g]["converged"], math.exp(f["b"][j]), max(0.0, 2 * (f["ll"] - null[g]["ll"]))) for g, f in full.items()]
    t = spark.createDataFrame(rows, "feature string, n bigint, events bigint, converged boolean, odds_ratio double, statistic double")
    return t.select("feature", "n", "events", "converged", *[_settled_when(c) for c in ("odds_ratio", "statistic")])


def m8_sentiment(spark: SparkSession, d: str) -> DataFrame:
    """Penalised logit by regime, before and after a day (M8)."""
    x = _specs(panel(spark, d), {"s1": ["s4w"]}).withColumn("regime", F.when(F.col("week") < SPLIT, "early").otherwise("late"))
    fits = pooled_fits(x, "regime", "y", ["x1"], firth=True)
    t = spark.createDataFrame([(g, f["n"], f["events"], f["converged"], math.exp(f["b"][1])) for g, f in fits.items()], "regime string, n bigint, events bigint, converged boolean, odds_ratio double")
    return t.select("regime", "n", "events", "converged", _settled_when("odds_ratio"))


def m9_sentiment(spark: SparkSession, d: str) -> DataFrame:
    """Coin effects, errors clustered by coin and week: the panel with its own sentiment and with that of all coins."""
    x = panel(spark, d)
    parts = [pooled_logit(x, "tail_down", [c], clusters=["coin", "week"], fixed_effects="coin").withColumn("panel", F.lit(name)) for name, c in (("own", "s4w"), ("shared", "shared4"))]
    return parts[0].unionByName(parts[1])


def k3_bands(spark: SparkSession, d: str) -> DataFrame:
    """What the AUC of each univariate specification is worth: below .55 chance, below .62 weak, else moderate (K3)."""
    t = m1_sentiment(spark, d).filter("auc is not null")
    return t.select("spec", "auc", F.when(F.col("auc") < 0.55, "chance").when(F.col("auc") < 0.62, "weak").otherwise("moderate").alias("verdict"))


def k3_survived(spark: SparkSession, d: str) -> DataFrame:
    """Whether sentiment survives the control for volume: same side of one and more than half of the distance kept (K3)."""
    x = durable(panel(spark, d).na.drop(subset=["s4w", "volume"]))
    alone, joint = (pooled_fits(_specs(x, {"c": columns}), "spec", "y", [f"x{k + 1}" for k in range(len(columns))]) for columns in (["s4w"], ["s4w", "volume"]))
    rows = [(math.exp(alone[g]["b"][1]), math.exp(joint[g]["b"][1])) for g in alone if g in joint and alone[g]["converged"] and joint[g]["converged"]]
    t = spark.createDataFrame(rows, "base double, controlled double")
    b, w = F.col("base") - 1, F.col("controlled") - 1
    return t.select(*r6(base=F.col("base"), controlled=F.col("controlled")), ((w * b > 0) & (F.abs(w) > 0.5 * F.abs(b))).alias("survived"))


def market(spark: SparkSession, d: str) -> DataFrame:
    """The one series of the equal-weight market: weekly labels, volatility, momentum, sentiment and volume over all coins."""
    r = returns(spark, d).groupBy("d").agg(F.avg("r").alias("r"), F.count("r").alias("k")).filter("k >= 2").select(F.lit("market").alias("coin"), "d", "r")
    x = durable(r.withColumn("level", F.exp(running_sum(F.col("r"), along(["coin"], "d")))))
    vols = trailing_volatility(recovery_weights(x)).withColumn("week", week_end(F.col("d"))).groupBy("coin", "week").agg(last_value("rwdv").alias("rwdv"))
    news = sentiment(spark, d).groupBy(week_end(F.col("week")).alias("week")).agg((F.sum(F.col("s") * F.col("n")) / F.sum(F.when(F.col("s").isNotNull(), F.col("n")))).alias("s"), F.sum("n").alias("n"))
    labels = durable(scar_flags(x)).join(vols, ["coin", "week"], "left").join(momentum(x), ["coin", "week"], "left").join(news, "week", "left")
    w = along(["coin"], "week")
    return labels.withColumns({"s4w": rolling_weighted_mean(F.col("s"), F.col("n"), w), "volume": F.log1p("n")})


def h4_volume(spark: SparkSession, d: str) -> DataFrame:
    """Walk-forward scores with and without news volume, and with even class weights, on the same rows (H4)."""
    x = durable(market(spark, d))
    specs = {"c0": ["s4w", "rwdv", "mom"], "c0_volume": ["s4w", "rwdv", "mom", "volume"]}
    parts = [metrics(durable(walk_forward(x, "coin", "week", specs, balanced=b, known="known")), ["spec"]).withColumn("balanced", F.lit(b)) for b in (False, True)]
    return parts[0].unionByName(parts[1])


# ---- SQL ----------------------------------------------------------------------------------------------------

_W4 = lambda x: f"({roll('sum', f'{x} * n', 4, 2, 'week')}) / ({roll('sum', 'n', 4, 2, 'week')})"
_PANEL = f"""{SCAR}, {SENT}, ow AS (SELECT coin, {FRI('week')} AS week, avg(s) AS own, sum(n) AS n FROM sen GROUP BY ALL), sh AS (SELECT week, avg(own) AS shared FROM ow GROUP BY week),
pj AS (SELECT lab.coin, lab.week, tail_down, own, n, shared FROM lab LEFT JOIN ow USING (coin, week) LEFT JOIN sh USING (week)),
pr AS (SELECT coin, week, tail_down, {_W4('own')} AS s4w, {_W4('shared')} AS shared4, ln(1 + n) AS volume FROM pj),
pn AS (SELECT *, lag(s4w) OVER w AS s4w_1, lag(volume) OVER w AS volume_1, lag(shared4) OVER w AS shared4_1 FROM pr WINDOW w AS (PARTITION BY coin ORDER BY week))"""


def _inverse(k: int, q: str) -> list[list[str]]:
    """Entries of the inverse of a symmetric matrix of 1 to 3 rows whose entries are named q00, q01 ..."""
    e = lambda i, j: f"{q}{min(i, j)}{max(i, j)}"
    if k == 1:
        return [[f"(1 / {e(0, 0)})"]]
    if k == 2:
        det = f"({e(0, 0)} * {e(1, 1)} - {e(0, 1)} * {e(0, 1)})"
        return [[f"({e(1, 1)} / {det})", f"(-{e(0, 1)} / {det})"], [f"(-{e(0, 1)} / {det})", f"({e(0, 0)} / {det})"]]
    minor = lambda i, j: "({0} * {1} - {2} * {3})".format(*[e(a, b) for a, b in ((sorted({0, 1, 2} - {i})[0], sorted({0, 1, 2} - {j})[0]), (sorted({0, 1, 2} - {i})[1], sorted({0, 1, 2} - {j})[1]), (sorted({0, 1, 2} - {i})[0], sorted({0, 1, 2} - {j})[1]), (sorted({0, 1, 2} - {i})[1], sorted({0, 1, 2} - {j})[0]))])
    det = f"({e(0, 0)} * {minor(0, 0)} - {e(0, 1)} * {minor(0, 1)} + {e(0, 2)} * {minor(0, 2)})"
    return [[f"({'-' if (i + j) % 2 else ''}{minor(i, j)} / {det})" for j in range(3)] for i in range(3)]


def newton_sql(rows: str, k: int, firth: bool = False, fixed: int | None = None, steps: int = 18, name: str = "") -> str:
    """CTEs that fit a logit per ``g`` by unrolled Newton steps: rows ``{rows}(g, y, x1 .. xk)``, result ``fit{name}`` (g, n, ev, b0 .., v11 .., ll, move).

    Closed-form inverses; with ``firth`` the leverages take a second pass in every step.
    """
    js, names = range(k + 1), [f"z{j}" for j in range(k + 1)]
    free = [j for j in js if j != fixed]
    pairs = [(i, j) for i in js for j in js if i <= j]
    eta = " + ".join(f"b{j} * z{j}" for j in js)
    out = [
        f"mo{name} AS MATERIALIZED (SELECT g, count(*) AS n, sum(y) AS ev, " + ", ".join(f"avg(x{j}) AS m{j}, stddev_pop(x{j}) AS s{j}" for j in js if j) + f" FROM {rows} GROUP BY g HAVING count(*) >= 10 AND sum(y) >= 2 AND sum(y) <= count(*) - 2)",
        f"zr{name} AS MATERIALIZED (SELECT g, y, 1.0::DOUBLE AS z0, " + ", ".join(f"(x{j} - m{j}) / CASE WHEN s{j} > 0 THEN s{j} ELSE 1 END AS z{j}" for j in js if j) + f" FROM {rows} JOIN mo{name} USING (g))",
        f"fb{name}0 AS MATERIALIZED (SELECT g, " + ", ".join(f"0.0::DOUBLE AS b{j}" for j in js) + f", 1.0::DOUBLE AS move FROM mo{name})",
    ]
    for t in range(steps + 1):
        q = f"fq{name}{t}"
        out.append(f"{q} AS MATERIALIZED (SELECT g, any_value(move) AS move, " + ", ".join(f"any_value(b{j}) AS b{j}, sum((y - p) * z{j}) AS g{j}" for j in js) + ", " + ", ".join(f"sum(p * (1 - p) * z{i} * z{j}) AS q{i}{j}" for i, j in pairs) + f", sum(CASE WHEN y > 0 THEN ln(p) ELSE ln(1 - p) END) AS ll FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS p FROM zr{name} JOIN fb{name}{t} USING (g)) GROUP BY g)")
        if t == steps:
            break
        score = [f"g{j}" for j in js]
        source = q
        if firth:
            inverse = _inverse(k + 1, "q")
            lever = " + ".join(f"z{i} * z{j} * {inverse[i][j]}" for i in js for j in js)
            source = f"fl{name}{t}"
            out.append(f"{source} AS MATERIALIZED (SELECT g, " + ", ".join(f"sum(h * (0.5 - p) * z{j}) AS f{j}" for j in js) + f" FROM (SELECT *, p * (1 - p) * ({lever}) AS h FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS p FROM zr{name} JOIN {q} USING (g))) GROUP BY g)")
            score = [f"(g{j} + f{j})" for j in js]
            source = f"(SELECT * FROM {q} JOIN {source} USING (g))"
        renamed = f"(SELECT *, " + ", ".join(f"q{min(free[a], free[b])}{max(free[a], free[b])} AS r{a}{b}" for a in range(len(free)) for b in range(a, len(free))) + f" FROM {source})"
        inverse = _inverse(len(free), "r")
        moves = {j: " + ".join(f"{inverse[a][b]} * {score[free[b]]}" for b in range(len(free))) for a, j in enumerate(free)}
        out.append(f"fb{name}{t + 1} AS MATERIALIZED (SELECT g, " + ", ".join(f"b{j} + coalesce(d{j}, 0) AS b{j}" for j in js) + ", greatest(" + ", ".join(f"abs(d{j})" for j in free) + ", 0) AS move FROM (SELECT g, " + ", ".join(f"b{j}, {moves.get(j, '0.0')} AS d{j}" for j in js) + f" FROM {renamed}))")
    inverse = _inverse(k + 1, "q")
    det = "(q00 * q11 - q01 * q01)" if k == 1 else "(q00 * (q11 * q22 - q12 * q12) - q01 * (q01 * q22 - q12 * q02) + q02 * (q01 * q12 - q11 * q02))"
    out.append(f"fit{name} AS (SELECT g, n, ev, " + ", ".join(f"b{j}, {inverse[j][j]} AS v{j}{j}" for j in js) + f", ll{f' + 0.5 * ln({det})' if firth else ''} AS ll, move < 1e-7 AS rest FROM fq{name}{steps} JOIN mo{name} USING (g))")
    return ",\n".join(out)


def _report_sql(k: int, feature: bool) -> str:
    p = "1 / (1 + exp(-(" + " + ".join(f"b{j} * z{j}" for j in range(k + 1)) + ")))"
    auc = f"au AS (SELECT g, (sum(CASE WHEN y > 0 THEN rk END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc FROM (SELECT g, y, rank() OVER (PARTITION BY g ORDER BY p) + (count(*) OVER (PARTITION BY g, p) - 1) / 2.0 AS rk FROM (SELECT zr.g, y, {p} AS p FROM zr JOIN fit USING (g))) GROUP BY g)"
    null = "(ev * ln(ev / n) + (n - ev) * ln(1 - ev / n))"
    if_rest = lambda x, n: f"CASE WHEN rest THEN {R6(x)} END AS {n}"
    parts = [f"SELECT g AS spec, {f"'x{j}' AS feature, " if feature else ''}n, CAST(ev AS BIGINT) AS events, rest AS converged, {if_rest(f'exp(b{j})', 'odds_ratio')}, {if_rest(f'b{j} / sqrt(v{j}{j})', 'z')}, {if_rest('auc', 'auc')}, {if_rest(f'1 - ll / {null}', 'mcfadden')} FROM fit JOIN au USING (g)" for j in range(1, k + 1)]
    return f"{auc} " + " UNION ALL ".join(parts)


_ST1 = "st AS (" + " UNION ALL ".join(f"SELECT '{n}' AS g, tail_down AS y, {c[0]} AS x1 FROM pn WHERE {c[0]} IS NOT NULL" for n, c in _SINGLES.items()) + ")"
_ST2 = "st AS (SELECT 'c0' AS g, tail_down AS y, s4w AS x1, volume AS x2, week FROM pn WHERE s4w IS NOT NULL AND volume IS NOT NULL)"
_OFF = lambda x, n, rest="rest": f"CASE WHEN {rest} THEN {R6(x)} END AS {n}"
SQL = {
    "m1_sentiment": f"WITH {_PANEL}, {_ST1}, {newton_sql('st', 1)}, {_report_sql(1, False)}",
    "m2_sentiment": f"WITH {_PANEL}, {_ST2}, {newton_sql('st', 2)}, {_report_sql(2, True)}",
    "m3_sentiment": f"""WITH {_PANEL}, {_ST2}, tr AS (SELECT * FROM st WHERE week < '{SPLIT}'), {newton_sql('tr', 2)},
te AS (SELECT y, 1 / (1 + exp(-(b0 + b1 * (x1 - m1) / CASE WHEN s1 > 0 THEN s1 ELSE 1 END + b2 * (x2 - m2) / CASE WHEN s2 > 0 THEN s2 ELSE 1 END))) AS p FROM st JOIN fit USING (g) JOIN mo USING (g) WHERE week >= '{SPLIT}'),
rk AS (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM te),
ag AS (SELECT count(*) AS n_test, sum(y) AS e, sum(CASE WHEN y > 0 THEN rk END) AS s, avg((y - p) * (y - p)) AS b FROM rk)
SELECT 's1' AS spec, n AS n_train, CAST(ev AS BIGINT) AS events_train, n_test, CAST(e AS BIGINT) AS events_test, rest AS converged, {_OFF('CASE WHEN e > 0 AND e < n_test THEN (s - e * (e + 1) / 2) / (e * (n_test - e)) END', 'auc')}, {_OFF('b', 'brier')} FROM fit, ag WHERE n_test > 0""",
    "m4_sentiment": f"WITH {_PANEL}, {_ST2}, {newton_sql('st', 2, True, None, 40)}, {newton_sql('st', 2, True, 1, 40, 'u')}, {newton_sql('st', 2, True, 2, 40, 'w')} "
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, fit.n, CAST(fit.ev AS BIGINT) AS events, fit.rest AND o.rest AS converged, {_OFF(f'exp(fit.b{j})', 'odds_ratio', 'fit.rest AND o.rest')}, {_OFF('greatest(0, 2 * (fit.ll - o.ll))', 'statistic', 'fit.rest AND o.rest')} FROM fit JOIN fit{t} o USING (g)" for j, f, t in ((1, "s4w", "u"), (2, "volume", "w"))),
    "m8_sentiment": f"WITH {_PANEL}, st AS (SELECT CASE WHEN week < '{SPLIT}' THEN 'early' ELSE 'late' END AS g, tail_down AS y, s4w AS x1 FROM pn WHERE s4w IS NOT NULL), {newton_sql('st', 1, True, None, 40)} SELECT g AS regime, n, CAST(ev AS BIGINT) AS events, rest AS converged, {_OFF('exp(b1)', 'odds_ratio')} FROM fit",
}
SQL["k3_bands"] = f"SELECT spec, auc, CASE WHEN auc < 0.55 THEN 'chance' WHEN auc < 0.62 THEN 'weak' ELSE 'moderate' END AS verdict FROM ({SQL['m1_sentiment']}) WHERE auc IS NOT NULL"
SQL["k3_survived"] = f"WITH {_PANEL}, {_ST2}, {newton_sql('st', 1, name='a')}, {newton_sql('st', 2, name='c')} SELECT {R6('base')} AS base, {R6('controlled')} AS controlled, (controlled - 1) * (base - 1) > 0 AND abs(controlled - 1) > 0.5 * abs(base - 1) AS survived FROM (SELECT exp(fita.b1) AS base, exp(fitc.b1) AS controlled FROM fita JOIN fitc USING (g) WHERE fita.rest AND fitc.rest)"
QUERIES = {f.__name__: f for f in (m1_sentiment, m2_sentiment, m3_sentiment, m4_sentiment, m8_sentiment, m9_sentiment, k3_bands, k3_survived, h4_volume)}
