"""Queries of the event study and of prediction metrics, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators.events import WINDOWS, abnormal_returns, agreement, bootstrap_means, decile_events, recovery, window_sums, window_tests
from marlstone.operators.joins import trailing_join
from marlstone.operators.metrics import metrics, roc_points
from marlstone.operators.windows import along, running_product, running_sum
from marlstone.plans.prepare import settled
from marlstone.plans.series import FRI, R6, r6
from marlstone.session import durable
from marlstone.sources.tables import table


def assets(spark: SparkSession, d: str) -> DataFrame:
    """Daily series by order priority: ``asset``, ``d``, ``r`` (standardised mean order value x 0.04), ``price`` compounding r."""
    v = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("v"))
    whole = Window.partitionBy("asset")
    x = v.withColumn("r", 0.04 * (F.col("v") - F.avg("v").over(whole)) / F.stddev_pop("v").over(whole))
    return x.withColumn("price", running_product(F.col("r"), along(["asset"], "d")))


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The series and its events, each cut once: both are read several times from here on."""
    series = durable(assets(spark, d))
    return series, durable(decile_events(series, "asset"))


def _ar(spark: SparkSession, d: str) -> DataFrame:
    series, events = _parts(spark, d)
    return durable(abnormal_returns(events, series, "asset"))


def _recovery(spark: SparkSession, d: str) -> DataFrame:
    series, events = _parts(spark, d)
    return recovery(events, series, "asset")


def e1_index(spark: SparkSession, d: str) -> DataFrame:
    """Price index of the returns as simple and as logarithmic ones (T4)."""
    w = along(["asset"], "d")
    return assets(spark, d).select("asset", "d", *r6(simple=F.col("price"), log=F.exp(running_sum(F.col("r"), w))))


def e2_events(spark: SparkSession, d: str) -> DataFrame:
    return decile_events(durable(assets(spark, d)), "asset").select("asset", "sign", "ev_date", *r6(week_ret=F.col("week_ret")))


def e3_abnormal(spark: SparkSession, d: str) -> DataFrame:
    return _ar(spark, d).select("asset", "sign", "ev_date", "t0", "rel", *r6(mu=F.col("mu"), sd=F.col("sd"), ar=F.col("ar")))


def e4_car(spark: SparkSession, d: str) -> DataFrame:
    return window_sums(_ar(spark, d), "asset").select("asset", "sign", "ev_date", "window", "days", *r6(car=F.col("car")))


def e5_tests(spark: SparkSession, d: str) -> DataFrame:
    """Patell, BMP, sign and rank statistics."""
    t = window_tests(_ar(spark, d), "asset")
    return t.select("sign", "window", "n", *r6(**{c: F.col(c) for c in ("mean_car", "patell_z", "bmp_z", "sign_z", "corrado_z")}))


def e9_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Percentile interval of the mean abnormal sum by sign and window."""
    cars = window_sums(_ar(spark, d), "asset").select("asset", "sign", "ev_date", "window", "car")
    return bootstrap_means(durable(cars), ["sign", "window"], replicates=10_000, ids=["asset", "sign", "ev_date", "window"], digits=6)


def e10_agreement(spark: SparkSession, d: str) -> DataFrame:
    """p-values of the four tests and whether a parametric and a non-parametric one agree."""
    t = agreement(window_tests(_ar(spark, d), "asset"))
    return t.select("sign", "window", "n", "agree", "agree_bonferroni", *r6(**{f"{c}_p": F.col(f"{c}_p") for c in ("patell", "bmp", "sign", "corrado")}))


def e11_recovery(spark: SparkSession, d: str) -> DataFrame:
    return _recovery(spark, d).select("asset", "sign", "ev_date", "rec50", "rec80", *r6(depth=F.col("depth")))


def e13_records(spark: SparkSession, d: str) -> DataFrame:
    """One record per event: its abnormal sums by window and its recovery."""
    series, events = _parts(spark, d)
    c = window_sums(abnormal_returns(events, series, "asset"), "asset").groupBy("asset", "sign", "ev_date").pivot("window", list(WINDOWS)).agg(F.first("car"))
    x = c.join(recovery(events, series, "asset"), ["asset", "sign", "ev_date"], "left")
    return x.select("asset", "sign", "ev_date", "rec50", "rec80", *r6(depth=F.col("depth"), **{f"car_{w}": F.col(w) for w in WINDOWS}))


def e12_before(spark: SparkSession, d: str) -> DataFrame:
    """Events with the mean discount and the shipments of the 28 days up to them, as their sentiment and news."""
    _, events = _parts(spark, d)
    daily = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.avg("l_discount").alias("s"), F.count("*").alias("n"))
    x = trailing_join(events.select("asset", "sign", "ev_date"), daily, [], "ev_date", "day", 28, [F.avg("s").alias("pre_sent"), F.sum("n").alias("pre_news")])
    return x.select("asset", "sign", "ev_date", "pre_news", *r6(pre_sent=F.col("pre_sent")))


def e14_summary(spark: SparkSession, d: str) -> DataFrame:
    """Median recovery and events not recovered, by sign; groups of three events at least."""
    r = _recovery(spark, d)
    g = r.groupBy("sign").agg(F.count("*").alias("n"), settled(F.median("depth")).alias("depth"), settled(F.median("rec50")).alias("med50"), settled(F.median("rec80")).alias("med80"), F.count_if(F.col("rec50").isNull()).alias("open50"), F.count_if(F.col("rec80").isNull()).alias("open80"))
    return g.filter("n >= 3")


def e15_path(spark: SparkSession, d: str) -> DataFrame:
    """Mean cumulated abnormal return by day around the event."""
    w = along(["asset", "sign", "ev_date"], "rel")
    x = _ar(spark, d).filter("rel >= -10").withColumn("car", running_sum(F.col("ar"), w))
    return x.groupBy("sign", "rel").agg(F.count("*").alias("n"), settled(F.avg("car")).alias("mean_car"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Scored labels by day: is the event an error or a purchase, scored by its value."""
    e = table(spark, d, "events")
    return e.select(F.to_date("ts").alias("day"), F.col("event_type").isin("error", "purchase").cast("int").alias("y"), (F.floor(F.col("value") / 5) / 100).alias("p"))


def v1_metrics(spark: SparkSession, d: str) -> DataFrame:
    """AUC, average precision, Brier score, precision and recall."""
    m = metrics(predictions(spark, d), ["day"])
    return m.select("day", "n", "events", *r6(**{c: F.col(c) for c in ("auc", "average_precision", "brier", "precision", "recall", "precision_at_k")}))


def v6_roc(spark: SparkSession, d: str) -> DataFrame:
    return roc_points(predictions(spark, d), ["day"]).select("day", "p", *r6(fpr=F.col("fpr"), tpr=F.col("tpr")))


QUERIES = {f.__name__: f for f in (e1_index, e2_events, e3_abnormal, e4_car, e5_tests, e9_bootstrap, e10_agreement, e11_recovery, e12_before, e13_records, e14_summary, e15_path, v1_metrics, v6_roc)}

_A = "PARTITION BY asset ORDER BY d"
ASSETS = f"""v AS (SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS v FROM orders GROUP BY ALL),
a1 AS (SELECT asset, d, 0.04 * (v - avg(v) OVER (PARTITION BY asset)) / stddev_pop(v) OVER (PARTITION BY asset) AS r FROM v),
a AS (SELECT *, exp(sum(ln(1 + r)) OVER ({_A})) AS price, row_number() OVER ({_A}) AS rn, count(*) OVER (PARTITION BY asset) AS len FROM a1)"""
EVENTS = ASSETS + f""",
ew0 AS (SELECT asset, {FRI("d")} AS week, exp(sum(ln(1 + r))) - 1 AS x FROM a GROUP BY ALL),
ec AS (SELECT asset, CAST(unnest(generate_series(min(week)::TIMESTAMP, max(week)::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS week FROM ew0 GROUP BY asset),
ew AS (SELECT asset, week, coalesce(x, 0) AS x FROM ec LEFT JOIN ew0 USING (asset, week)),
eq AS (SELECT asset, quantile_cont(x, 0.1) AS lo, quantile_cont(x, 0.9) AS hi FROM ew GROUP BY asset),
es AS (SELECT asset, '-' AS sign, week, x, x AS o FROM ew JOIN eq USING (asset) WHERE x <= lo UNION ALL SELECT asset, '+', week, x, -x FROM ew JOIN eq USING (asset) WHERE x >= hi),
eg AS (SELECT *, CASE WHEN week - lag(week) OVER (PARTITION BY asset, sign ORDER BY week) <= 30 THEN 0 ELSE 1 END AS fresh FROM es),
ek AS (SELECT *, sum(fresh) OVER (PARTITION BY asset, sign ORDER BY week) AS c FROM eg),
ev AS (SELECT asset, sign, arg_min(week, (o, week)) AS ev_date, arg_min(x, (o, week)) AS week_ret FROM ek GROUP BY asset, sign, c),
et AS (SELECT ev.*, b.d AS t0, b.rn AS pos, b.len FROM ev ASOF JOIN a b ON ev.asset = b.asset AND ev.ev_date <= b.d)"""
AR = EVENTS + """,
l0 AS (SELECT et.asset, sign, ev_date, t0, CAST(a.rn - pos AS INTEGER) AS rel, a.r FROM et JOIN a ON a.asset = et.asset AND a.rn BETWEEN pos - 120 AND pos + 10 WHERE pos - 1 > 120 AND pos - 1 < et.len - 11),
l1 AS (SELECT *, avg(CASE WHEN rel <= -31 THEN r END) OVER w AS mu, stddev_samp(CASE WHEN rel <= -31 THEN r END) OVER w AS sd FROM l0 WINDOW w AS (PARTITION BY asset, sign, ev_date)),
ar AS (SELECT *, r - mu AS ar FROM l1 WHERE sd > 0 AND (rel <= -31 OR rel >= -10)),
wn(name, wa, wb) AS (VALUES """ + ", ".join(f"('{n}', {a}, {b})" for n, (a, b) in WINDOWS.items()) + """),
cars AS (SELECT asset, sign, ev_date, name AS win, sum(ar) AS car, any_value(sd) AS sd, count(*) AS days FROM ar JOIN wn ON rel BETWEEN wa AND wb GROUP BY ALL)"""
TESTS = AR + """,
zz AS (SELECT sign, win, days, count(*) AS n, avg(car) AS mean_car, sum(car / (sd * sqrt(1 + 1 / 90.0))) / sqrt(count(*) * days * 89 / 87.0) AS patell_z,
  sqrt(count(*)) * avg(car / (sd * sqrt(days) * sqrt(1 + 1 / 90.0))) / nullif(stddev_samp(car / (sd * sqrt(days) * sqrt(1 + 1 / 90.0))), 0) AS bmp_z, count(*) FILTER (WHERE car > 0) AS w FROM cars GROUP BY sign, win, days),
ph AS (SELECT sign, avg(p) AS ph FROM (SELECT sign, avg(CAST(ar > 0 AS DOUBLE)) AS p FROM ar WHERE rel <= -31 GROUP BY asset, sign, ev_date) GROUP BY sign),
kk AS (SELECT sign, rel, (rank() OVER (PARTITION BY asset, sign, ev_date ORDER BY ar) + (count(*) OVER (PARTITION BY asset, sign, ev_date, ar) - 1) / 2.0) / (count(*) OVER (PARTITION BY asset, sign, ev_date) + 1) - 0.5 AS k FROM ar),
dd AS (SELECT sign, rel, avg(k) AS a FROM kk GROUP BY ALL), sk AS (SELECT sign, sqrt(avg(a * a)) AS sk FROM dd GROUP BY sign),
rs AS (SELECT sign, name AS win, sum(a) AS rs FROM dd JOIN wn ON rel BETWEEN wa AND wb GROUP BY ALL)"""
REC = EVENTS + """,
re AS (SELECT * FROM et WHERE pos - 1 >= 30 AND pos - 1 < len - 1),
rn0 AS (SELECT re.asset, sign, ev_date, max(CASE WHEN a.rn <= pos THEN price END) AS peak, min(CASE WHEN a.rn >= pos - 7 THEN price END) AS low,
  arg_min(a.rn, (price, a.rn)) FILTER (WHERE a.rn >= pos - 7) AS lrn, arg_min(a.d, (price, a.rn)) FILTER (WHERE a.rn >= pos - 7) AS ld
  FROM re JOIN a ON a.asset = re.asset AND a.rn BETWEEN pos - 30 AND pos + 29 GROUP BY ALL),
rec AS (SELECT rn0.asset, sign, ev_date, (low - peak) / peak AS depth, min(CASE WHEN low < peak AND price >= low + 0.5 * (peak - low) THEN a.d - ld END) AS rec50,
  min(CASE WHEN low < peak AND price >= low + 0.8 * (peak - low) THEN a.d - ld END) AS rec80 FROM rn0 JOIN a ON a.asset = rn0.asset AND a.rn BETWEEN lrn AND lrn + 180 GROUP BY ALL)"""
_PRED = """pr AS (SELECT CAST(ts AS DATE) AS day, CAST(event_type IN ('error', 'purchase') AS INTEGER) AS y, floor(value / 5) / 100 AS p FROM events),
g AS (SELECT day, p, count(*) AS n, sum(y) AS pos FROM pr GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY day) AS ev, sum(n) OVER (PARTITION BY day) AS al FROM g WINDOW w AS (PARTITION BY day ORDER BY p DESC))"""
_Z = "SELECT sign, win, n, patell_z AS patell, bmp_z AS bmp, (w - n * ph) / nullif(sqrt(n * ph * (1 - ph)), 0) AS sg, rs / (sqrt(days) * nullif(sk, 0)) AS corrado FROM zz JOIN ph USING (sign) JOIN sk USING (sign) JOIN rs USING (sign, win)"


def _tail_sql(z: str) -> str:
    """The series of the error function with its double factorials by the gamma function."""
    x = f"(least(abs({z}), 8) / sqrt(2))"
    terms = f"list_sum(list_transform(range(0, 161), lambda k: exp(k * ln(2 * {x} * {x}) + ln({x}) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()))))"
    return f"CASE WHEN {z} IS NULL THEN NULL WHEN abs({z}) >= 8 THEN 0 WHEN {z} = 0 THEN 1 ELSE greatest(0, 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * {terms}) END"


_CUTS = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]
_WEIGHT = " + ".join(f"CAST(u > {c!r} AS INTEGER)" for c in _CUTS)
_AGREE = lambda a: f"((coalesce(p1 < {a}, FALSE) OR coalesce(p2 < {a}, FALSE)) AND (coalesce(p3 < {a}, FALSE) OR coalesce(p4 < {a}, FALSE)))"
SQL = {
    "e12_before": f"WITH {EVENTS}, sd AS (SELECT CAST(l_shipdate AS DATE) AS day, avg(l_discount) AS s, count(*) AS n FROM lineitem GROUP BY ALL) SELECT asset, sign, ev_date, CAST(sum(n) AS BIGINT) AS pre_news, {R6('avg(s)')} AS pre_sent FROM ev LEFT JOIN sd ON sd.day > ev_date - 28 AND sd.day <= ev_date GROUP BY ALL",
    "e10_agreement": f"WITH {TESTS}, z AS ({_Z}), p AS (SELECT sign, win, n, {_tail_sql('patell')} AS p1, {_tail_sql('bmp')} AS p2, {_tail_sql('sg')} AS p3, {_tail_sql('corrado')} AS p4 FROM z) SELECT sign, win AS \"window\", n, {_AGREE(0.05)} AS agree, {_AGREE('0.05 / 4')} AS agree_bonferroni, {R6('p1')} AS patell_p, {R6('p2')} AS bmp_p, {R6('p3')} AS sign_p, {R6('p4')} AS corrado_p FROM p",
    "e9_bootstrap": f"WITH {AR}, u AS (SELECT sign, win, car, b, CAST('0x' || left(md5(asset || '|' || sign || '|' || ev_date || '|' || win || '|' || b || '|7'), 8) AS BIGINT) / 4294967296.0 AS u FROM cars, range(1, 10001) t(b)), m AS (SELECT sign, win, b, sum(car * ({_WEIGHT})) / nullif(sum({_WEIGHT}), 0) AS m FROM u GROUP BY ALL), q AS (SELECT sign, win, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m WHERE m IS NOT NULL GROUP BY ALL) SELECT sign, win AS \"window\", count(*) AS n, {R6('avg(car)')} AS mean, {R6('any_value(lo)')} AS lo, {R6('any_value(hi)')} AS hi FROM cars JOIN q USING (sign, win) GROUP BY ALL",
    "e1_index": f"WITH {ASSETS} SELECT asset, d, {R6('price')} AS simple, {R6(f'exp(sum(r) OVER ({_A}))')} AS log FROM a",
    "e2_events": f"WITH {EVENTS} SELECT asset, sign, ev_date, {R6('week_ret')} AS week_ret FROM ev",
    "e3_abnormal": f"WITH {AR} SELECT asset, sign, ev_date, t0, rel, {R6('mu')} AS mu, {R6('sd')} AS sd, {R6('ar')} AS ar FROM ar",
    "e4_car": f"WITH {AR} SELECT asset, sign, ev_date, win AS \"window\", days, {R6('car')} AS car FROM cars",
    "e5_tests": f"WITH {TESTS} SELECT sign, win AS \"window\", n, {R6('mean_car')} AS mean_car, {R6('patell_z')} AS patell_z, {R6('bmp_z')} AS bmp_z, {R6('(w - n * ph) / nullif(sqrt(n * ph * (1 - ph)), 0)')} AS sign_z, {R6('rs / (sqrt(days) * nullif(sk, 0))')} AS corrado_z FROM zz JOIN ph USING (sign) JOIN sk USING (sign) JOIN rs USING (sign, win)",
    "e11_recovery": f"WITH {REC} SELECT asset, sign, ev_date, CAST(rec50 AS INTEGER) AS rec50, CAST(rec80 AS INTEGER) AS rec80, {R6('depth')} AS depth FROM rec",
    "e13_records": f"WITH {AR}, {REC[len(EVENTS) + 2:]}, pv AS (SELECT asset, sign, ev_date, " + ", ".join(f"max(car) FILTER (WHERE win = '{w}') AS c_{w}" for w in WINDOWS) + f" FROM cars GROUP BY ALL) SELECT asset, sign, ev_date, CAST(rec50 AS INTEGER) AS rec50, CAST(rec80 AS INTEGER) AS rec80, {R6('depth')} AS depth, " + ", ".join(f"{R6(f'c_{w}')} AS car_{w}" for w in WINDOWS) + " FROM pv LEFT JOIN rec USING (asset, sign, ev_date)",
    "e14_summary": f"WITH {REC} SELECT sign, count(*) AS n, {R6('median(depth)')} AS depth, {R6('median(rec50)')} AS med50, {R6('median(rec80)')} AS med80, count(*) FILTER (WHERE rec50 IS NULL) AS open50, count(*) FILTER (WHERE rec80 IS NULL) AS open80 FROM rec GROUP BY sign HAVING count(*) >= 3",
    "e15_path": f"WITH {AR}, cp AS (SELECT sign, rel, sum(ar) OVER (PARTITION BY asset, sign, ev_date ORDER BY rel) AS car FROM ar WHERE rel >= -10) SELECT sign, rel, count(*) AS n, {R6('avg(car)')} AS mean_car FROM cp GROUP BY ALL",
    "v1_metrics": f"WITH {_PRED} SELECT day, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS events, {R6('sum(CASE WHEN ev > 0 AND ev < al THEN pos * (al - ev - (seen - tp) + (n - pos) / 2.0) / (ev * (al - ev)) END)')} AS auc, {R6('sum(CASE WHEN ev > 0 THEN pos / ev * tp / seen END)')} AS average_precision, {R6('sum(pos * (1 - p) * (1 - p) + (n - pos) * p * p) / sum(n)')} AS brier, {R6('coalesce(sum(CASE WHEN p >= 0.5 THEN pos END) / nullif(sum(CASE WHEN p >= 0.5 THEN n END), 0), 0)')} AS precision, {R6('coalesce(coalesce(sum(CASE WHEN p >= 0.5 THEN pos END), 0) / nullif(sum(pos), 0), 0)')} AS recall, {R6('coalesce(sum(greatest(0, least(n, ev - (seen - n))) * pos / n) / nullif(sum(pos), 0), 0)')} AS precision_at_k FROM c GROUP BY day",
    "v6_roc": f"WITH {_PRED} SELECT day, p, {R6('(seen - tp) / nullif(al - ev, 0)')} AS fpr, {R6('tp / nullif(ev, 0)')} AS tpr FROM c",
}
