"""Event study on series in long form: abnormal returns around events, tests over windows, recovery."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.joins import asof_forward, positional_join
from marlstone.operators.labels import weekly
from marlstone.operators.windows import along, average_rank, gap_clusters

#: Offsets of the estimation and event windows from the event's row, both ends included.
ESTIMATION = (-120, -31)
EVENT = (-10, 10)
WINDOWS = {"full": (-10, 10), "before": (-10, -1), "day": (0, 0), "after": (1, 10)}


def decile_events(returns: DataFrame, key: str, day: str = "d", r: str = "r", q: float = 0.10, gap_days: int = 30, kind: str = "simple") -> DataFrame:
    """``key``, ``sign``, ``ev_date``, ``week_ret``: the worst and best weeks' deciles, nearby ones merged.

    Weekly returns compound ``1 + r`` (``kind="simple"``) or sum logs (``"log"``). Of a run of tail
    weeks no more than ``gap_days`` apart the outermost one stays, the earlier of equals.
    """
    agg = F.exp(F.sum(F.log1p(r))) - 1 if kind == "simple" else F.exp(F.sum(r)) - 1
    w = weekly(returns, {"week_ret": agg}, key, day).withColumn("week_ret", F.coalesce("week_ret", F.lit(0.0)))
    cuts = w.groupBy(key).agg(F.percentile("week_ret", F.lit(q)).alias("__lo"), F.percentile("week_ret", F.lit(1 - q)).alias("__hi"))
    w = w.join(cuts, key)

    def side(rows: DataFrame, sign: str, first: Column) -> DataFrame:
        c = gap_clusters(rows, [key], "week", gap_days)
        best = F.min(F.struct(first.alias("__o"), "week", "week_ret")).alias("__b")
        return c.groupBy(key, "cluster_id").agg(best).select(key, F.lit(sign).alias("sign"), F.col("__b.week").alias("ev_date"), F.col("__b.week_ret").alias("week_ret"))

    return side(w.filter("week_ret <= __lo"), "-", F.col("week_ret")).unionByName(side(w.filter("week_ret >= __hi"), "+", -F.col("week_ret")))


def abnormal_returns(events: DataFrame, series: DataFrame, key: str, day: str = "d", r: str = "r") -> DataFrame:
    """Per event and ``rel`` day: ``ar`` = return minus the estimation window's mean, with ``mu`` and ``sd``.

    The event's row is the first at or after ``ev_date``. Events without a whole estimation window
    before and event window after them (one row to spare on each side), or without any spread in
    it, are left out. Only the rows in the windows are touched, by an equi-join on the position.
    """
    whole = Window.partitionBy(key)
    s = series.withColumns({"__rn": F.row_number().over(along([key], day)), "__n": F.count("*").over(whole)})
    at = asof_forward(events, series.select(key, day), [key], "ev_date", day, "t0")
    at = at.join(s.select(key, F.col(day).alias("t0"), F.col("__rn").alias("__pos"), F.col("__n").alias("__len")), [key, "t0"])
    at = at.filter((F.col("__pos") - 1 > -ESTIMATION[0]) & (F.col("__pos") - 1 < F.col("__len") - EVENT[1] - 1)).drop("__len")
    rows = s.select(key, "__rn", F.col(r).alias("__r"))
    long = positional_join(at, rows, [key], "__pos", "__rn", (ESTIMATION[0], EVENT[1]))
    estimation = F.when(F.col("rel") <= ESTIMATION[1], F.col("__r"))
    per = Window.partitionBy(key, "sign", "ev_date")
    long = long.withColumns({"mu": F.avg(estimation).over(per), "sd": F.stddev_samp(estimation).over(per)})
    long = long.filter((F.col("sd") > 0) & ((F.col("rel") <= ESTIMATION[1]) | (F.col("rel") >= EVENT[0])))
    return long.withColumn("ar", F.col("__r") - F.col("mu")).drop("__r", "__pos")


def window_sums(ar: DataFrame, key: str) -> DataFrame:
    """``car`` of every event and window."""
    w = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in WINDOWS.items()])).alias("__w")
    x = ar.filter(F.col("rel") >= EVENT[0]).select("*", w).filter(F.col("rel").between(F.col("__w.a"), F.col("__w.b")))
    return x.groupBy(key, "sign", "ev_date", F.col("__w.name").alias("window")).agg(F.sum("ar").alias("car"), F.first("sd").alias("sd"), F.count("*").alias("days"))


def window_tests(ar: DataFrame, key: str) -> DataFrame:
    """Four z statistics per sign and window: Patell, BMP, generalised sign and Corrado rank; NULL where undefined."""
    length = ESTIMATION[1] - ESTIMATION[0] + 1
    cars = window_sums(ar, key)
    forecast = math.sqrt(1 + 1 / length)
    cars = cars.withColumns({"csar": F.col("car") / (F.col("sd") * forecast), "scar": F.col("car") / (F.col("sd") * F.sqrt("days") * forecast)})
    n = F.count("*")
    z = cars.groupBy("sign", "window", "days").agg(
        n.alias("n"), F.avg("car").alias("mean_car"), (F.sum("csar") / F.sqrt(n * F.col("days") * (length - 1) / (length - 3))).alias("patell_z"),
        (F.sqrt(n) * F.avg("scar") / F.when(F.stddev_samp("scar") > 0, F.stddev_samp("scar"))).alias("bmp_z"), F.count_if(F.col("car") > 0).alias("positive"),
    )
    share = ar.filter(F.col("rel") <= ESTIMATION[1]).groupBy(key, "sign", "ev_date").agg(F.avg((F.col("ar") > 0).cast("double")).alias("p"))
    p_hat = share.groupBy("sign").agg(F.avg("p").alias("p_hat"))
    k = ar.withColumn("k", average_rank(F.col("ar"), [key, "sign", "ev_date"]) / (F.count("*").over(Window.partitionBy(key, "sign", "ev_date")) + 1) - 0.5)
    daily = k.groupBy("sign", "rel").agg(F.avg("k").alias("a"))
    spread = daily.groupBy("sign").agg(F.sqrt(F.avg(F.col("a") * F.col("a"))).alias("s_k"))
    w = F.explode(F.array(*[F.struct(F.lit(m).alias("name"), F.lit(a).alias("a"), F.lit(b).alias("b")) for m, (a, b) in WINDOWS.items()])).alias("__w")
    ranks = daily.select("*", w).filter(F.col("rel").between(F.col("__w.a"), F.col("__w.b"))).groupBy("sign", F.col("__w.name").alias("window")).agg(F.sum("a").alias("rank_sum"))
    x = z.join(p_hat, "sign").join(spread, "sign").join(ranks, ["sign", "window"])
    denominator = F.sqrt(F.col("n") * F.col("p_hat") * (1 - F.col("p_hat")))
    return x.select("sign", "window", "n", "mean_car", "patell_z", "bmp_z", ((F.col("positive") - F.col("n") * F.col("p_hat")) / F.when(denominator > 0, denominator)).alias("sign_z"), (F.col("rank_sum") / (F.sqrt("days") * F.when(F.col("s_k") > 0, F.col("s_k")))).alias("corrado_z"))


def two_sided_p(z: Column) -> Column:
    """Tail probability of the normal distribution on both sides, in the JVM.

    One less the error function by its series of positive terms; right to 1e-14, and 0 from eight
    deviations on, where it is below that. NULL and NaN have none.
    """
    x = F.least(F.abs(z), F.lit(8.0)) / math.sqrt(2)
    start = F.struct(x.alias("term"), x.alias("sum"))

    def more(acc: Column, n: Column) -> Column:
        term = acc["term"] * 2 * x * x / (2 * n + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1.0).cast("int"), F.lit(160)), start, more)["sum"]
    p = F.greatest(F.lit(0.0), 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * series)
    return F.when(z.isNotNull() & ~F.isnan(z), F.when(F.abs(z) >= 8, 0.0).otherwise(p))


def agreement(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """p-values, and whether a parametric and a non-parametric test agree; also at the Bonferroni level."""
    names = ("patell", "bmp", "sign", "corrado")
    t = tests.withColumns({f"{n}_p": two_sided_p(F.col(f"{n}_z")) for n in names})
    hit = lambda n, a: F.coalesce(F.col(f"{n}_p") < a, F.lit(False))
    both = lambda a: (hit("patell", a) | hit("bmp", a)) & (hit("sign", a) | hit("corrado", a))
    return t.withColumns({"agree": both(alpha), "agree_bonferroni": both(alpha / len(WINDOWS))})


def bootstrap_means(cars: DataFrame, groups: list[str], value: str = "car", replicates: int = 10_000, alpha: float = 0.05, seed: int = 7, ids: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Percentile interval of the mean by a Poisson bootstrap: ``groups``, ``mean``, ``lo``, ``hi``.

    Every row draws its own weight in every replicate from a hash of its content (or of ``ids``, columns
    that tell rows apart), so replicates are sums with map-side combining, need no sample in one
    place, and come out alike on every run. ``digits`` rounds the results, halves settled upward.
    """
    b = cars.withColumn("__b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ids or cars.columns], F.col("__b").cast("string"), F.lit(str(seed))))
    u = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double") / 2.0**32
    cuts, total, term = [], 0.0, math.exp(-1)
    for k in range(12):
        total, term = total + term, term / (k + 1)
        cuts.append(total)
    weight = sum(((u > c).cast("int") for c in cuts[1:]), (u > cuts[0]).cast("int"))
    b = b.withColumn("__w", weight)
    means = b.groupBy(*groups, "__b").agg((F.sum(F.col(value) * F.col("__w")) / F.sum("__w")).alias("__m"))
    bands = means.groupBy(*groups).agg(F.percentile("__m", F.lit(alpha / 2)).alias("lo"), F.percentile("__m", F.lit(1 - alpha / 2)).alias("hi"))
    out = cars.groupBy(*groups).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).join(bands, groups)
    return out if digits is None else out.withColumns({c: F.round(F.col(c) + 2e-9, digits) for c in ("mean", "lo", "hi")})


def recovery(events: DataFrame, series: DataFrame, key: str, day: str = "d", price: str = "price", horizon: int = 180) -> DataFrame:
    """``depth`` of the fall around each event and days from its low to regain 50 and 80 % (NULL: not within ``horizon`` rows).

    Peak over the 31 rows up to the event, low from 7 rows before to 29 after it. Needs 30 rows before
    the event and one after.
    """
    whole = Window.partitionBy(key)
    s = series.withColumns({"__rn": F.row_number().over(along([key], day)), "__n": F.count("*").over(whole)})
    at = asof_forward(events, series.select(key, day), [key], "ev_date", day, "t0")
    at = at.join(s.select(key, F.col(day).alias("t0"), F.col("__rn").alias("__pos"), F.col("__n").alias("__len")), [key, "t0"])
    at = at.filter((F.col("__pos") - 1 >= 30) & (F.col("__pos") - 1 < F.col("__len") - 1))
    near = positional_join(at, s.select(key, "__rn", F.col(day).alias("__d"), F.col(price).alias("__p")), [key], "__pos", "__rn", (-30, 29))
    ids = [key, "sign", "ev_date", "__pos"]
    low = F.min(F.when(F.col("rel") >= -7, F.struct(F.col("__p").alias("p"), F.col("rel").alias("rel"), F.col("__d").alias("d"))))
    x = near.groupBy(*ids).agg(F.max(F.when(F.col("rel") <= 0, F.col("__p"))).alias("peak"), low.alias("low"))
    x = x.withColumns({"depth": (F.col("low.p") - F.col("peak")) / F.col("peak"), "__from": F.col("__pos") + F.col("low.rel")})
    ahead = positional_join(x.filter("depth < 0").select(*ids, "__from", "peak", "low"), s.select(key, "__rn", F.col(day).alias("__d"), F.col(price).alias("__p")), [key], "__from", "__rn", (0, horizon))
    reached = lambda f: F.min(F.when(F.col("__p") >= F.col("low.p") + f * (F.col("peak") - F.col("low.p")), F.datediff("__d", F.col("low.d"))))
    days = ahead.groupBy(*ids).agg(reached(0.5).alias("rec50"), reached(0.8).alias("rec80"))
    return x.join(days, ids, "left").select(key, "sign", "ev_date", "depth", "rec50", "rec80")
