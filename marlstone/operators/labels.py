"""Weekly frames, recovery-weighted volatility and labels of tail and slow-to-recover moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.calendar import spine, week_end
from marlstone.operators.windows import along, forward_fill, log_return, rolling, rows_until

DAYS_A_YEAR = 365


def with_returns(prices: DataFrame, key: str = "coin", day: str = "d", level: str = "level") -> DataFrame:
    return prices.withColumn("r", log_return(F.col(level), along([key], day)))


def normalised(prices: DataFrame, key: str = "coin", day: str = "d", level: str = "level", least_rows: int = 200) -> DataFrame:
    """Add ``rel``, the level relative to its series' first one; series with fewer than ``least_rows`` rows are left out.

    The rows are counted and the first level is taken by one aggregate that combines before the shuffle.
    """
    first = prices.groupBy(key).agg(F.count("*").alias("__n"), F.min_by(level, day).alias("__f")).filter(F.col("__n") >= least_rows)
    return prices.join(first, key).withColumn("rel", F.col(level) / F.col("__f")).drop("__n", "__f")


def recovery_weights(df: DataFrame, key: str = "coin", day: str = "d", level: str = "level", horizon: int = 10, fraction: float = 0.5) -> DataFrame:
    """Add ``w``: on a day of loss the rows until ``fraction`` of it is regained, capped, over ``horizon``; else 0."""
    win = along([key], day)
    before = F.lag(level).over(win)
    d = df.withColumns({"__before": before, "__target": F.col(level) + fraction * (before - F.col(level))})
    d = d.withColumn("__tau", rows_until(F.col(level), F.col("__target"), win, horizon))
    w = F.when(F.col(level) < F.col("__before"), F.coalesce("__tau", F.lit(horizon)) / horizon).otherwise(F.lit(0.0))
    return d.withColumn("w", w).drop("__before", "__target", "__tau")


def trailing_volatility(df: DataFrame, key: str = "coin", day: str = "d", n: int = 63, horizon: int = 10) -> DataFrame:
    """Add ``rwdv``, ``semidev`` and ``sd`` over ``n`` rows, annualised; needs ``r`` and ``w``.

    The recovery-weighted one looks back from ``horizon`` rows ago, when all recoveries are known.
    """
    win = along([key], day)
    down = F.when(F.col("r").isNotNull(), F.pow(F.least(F.col("r"), F.lit(0.0)), F.lit(2)))
    d = df.withColumns({"__down": down, "__late": F.lag(down * F.col("w"), horizon).over(win)})
    return d.withColumns({
        "rwdv": F.sqrt(DAYS_A_YEAR * rolling("avg", F.col("__late"), win, n)),
        "semidev": F.sqrt(DAYS_A_YEAR * rolling("avg", F.col("__down"), win, n)),
        "sd": rolling("stddev_samp", F.col("r"), win, n) * F.sqrt(F.lit(DAYS_A_YEAR)),
    }).drop("__down", "__late")


def weekly(df: DataFrame, aggs: dict[str, Column], key: str = "coin", day: str = "d", fill: dict | None = None) -> DataFrame:
    """Aggregate into weeks ending on a Friday; weeks without rows between the first and last come out too."""
    own = df.withColumn("week", week_end(F.col(day)))
    made = own.groupBy(key, "week").agg(*[c.alias(n) for n, c in aggs.items()])
    all_weeks = spine(made, "week", [key], "7 days", "week")
    out = all_weeks.join(made, [key, "week"], "left")
    return out.fillna(fill) if fill else out


def last_value(x: str, day: str = "d") -> Column:
    """The last value that is not NULL."""
    return F.max_by(F.col(x), F.when(F.col(x).isNotNull(), F.col(day)))


def scar_flags(df: DataFrame, key: str = "coin", day: str = "d", level: str = "level", fraction: float = 0.5, observations: int = 15) -> DataFrame:
    """``key``, ``week``, ``ret_1w``, ``ret_1w_fwd``, ``scar``, ``resolved``, ``known`` for all weeks but a key's last; needs ``r``.

    scar: the low of the next week lies below this week's last level and none of the next
    ``observations`` rows after that low regains ``fraction`` of the fall. Too few rows left to tell
    count as a scar (``resolved`` is then false). ``known`` is the day on which the outcome is settled:
    the end of the next week, or after a fall the day of the last of those rows; NULL if they never came. If the week's Friday has no row, the next week's
    first row opens the segment and is not part of it.
    """
    win = along([key], day)
    weeks = weekly(df, {"ret_1w": F.sum("r"), "start": last_value(level, day)}, key, day, {"ret_1w": 0.0})
    ahead = win.rowsBetween(1, observations)
    prev = F.lag(day).over(win)
    opening = F.coalesce((week_end(prev) < week_end(F.col(day))) & (prev != F.date_sub(week_end(F.col(day)), 7)), F.lit(False))
    marked = df.withColumns({"__best": F.max(level).over(ahead), "__left": F.count(level).over(ahead), "__end": F.lead(day, observations).over(win), "__opens": opening})
    low = F.min(F.struct(F.col(level).alias("v"), F.col(day).alias("d"), F.col("__best").alias("best"), F.col("__left").alias("left"), F.col("__end").alias("end")))
    lows = marked.filter(~F.col("__opens")).groupBy(key, F.date_sub(week_end(F.col(day)), 7).alias("week")).agg(low.alias("low"))
    nxt = F.lead("ret_1w").over(along([key], "week"))
    d = weeks.withColumn("ret_1w_fwd", nxt).filter(F.col("ret_1w_fwd").isNotNull()).join(lows, [key, "week"], "left")
    target = F.col("low.v") + fraction * (F.col("start") - F.col("low.v"))
    fell = F.coalesce(F.col("low.v") < F.col("start"), F.lit(False))
    regained = F.coalesce(F.col("low.best") >= target, F.lit(False))
    return d.select(key, "week", "ret_1w", "ret_1w_fwd", (fell & ~regained).alias("scar"), (~fell | regained | (F.col("low.left") >= observations)).alias("resolved"), F.when(fell, F.greatest("low.end", F.when(F.col("low.end").isNotNull(), F.date_add("week", 7)))).otherwise(F.date_add("week", 7)).alias("known"))


def decile_labels(flags: DataFrame, key: str = "coin", tail: float = 0.10) -> DataFrame:
    """Add ``tail_down`` (tail and scar), ``tail_up`` and ``cand_down`` by the key's own exact quantiles.

    The quantiles are over all weeks of the key, its last one included.
    """
    last = flags.groupBy(key).agg(F.max_by("ret_1w_fwd", "week").alias("x"))
    cuts = flags.select(key, F.col("ret_1w").alias("x")).unionByName(last).groupBy(key).agg(F.percentile("x", F.lit(tail)).alias("__lo"), F.percentile("x", F.lit(1 - tail)).alias("__hi"))
    d = flags.join(cuts, key)
    down = F.col("ret_1w_fwd") <= F.col("__lo")
    return d.select(*flags.columns, (down & F.col("scar")).cast("int").alias("tail_down"), (F.col("ret_1w_fwd") >= F.col("__hi")).cast("int").alias("tail_up"), down.cast("int").alias("cand_down"))


def monthly_forward(df: DataFrame, key: str = "coin", day: str = "d", n: int = 63) -> DataFrame:
    """``key``, ``month_end`` and ``forward_return``: sum of the next ``n`` daily returns, as known on a month's last row that has it."""
    win = along([key], day)
    d = df.withColumn("__s", rolling("sum", F.col("r"), win, n))
    d = d.withColumn("__f", F.lead("__s", n).over(win))
    return d.groupBy(key, F.last_day(day).alias("month_end")).agg(last_value("__f", day).alias("forward_return")).filter(F.col("forward_return").isNotNull())


def tail_labels(df: DataFrame, x: str, key: str = "coin", method: str = "quantile", tail: float = 0.06, z: float = 2.0, day: str = "week") -> DataFrame:
    """Add ``forward_zscore`` and ``tail_label`` in {-1, 0, 1}, by ``quantile`` (inclusive), ``global_z`` (strict) or ``evt`` (``models.evt_labels``, without the score)."""
    if method == "evt":
        from marlstone.operators.models import evt_labels

        return evt_labels(df, [key], day, x)
    stats = df.groupBy(key).agg(F.avg(x).alias("__mu"), F.stddev_samp(x).alias("__sd"), F.percentile(x, F.lit(tail)).alias("__lo"), F.percentile(x, F.lit(1 - tail)).alias("__hi"))
    d = df.join(stats, key).withColumn("forward_zscore", (F.col(x) - F.col("__mu")) / F.when(F.col("__sd") > 0, F.col("__sd")))
    up, down = {"quantile": (F.col(x) >= F.col("__hi"), F.col(x) <= F.col("__lo")), "global_z": (F.col("forward_zscore") > z, F.col("forward_zscore") < -z)}[method]
    return d.withColumn("tail_label", F.when(up, 1).when(down, -1).otherwise(0)).drop("__mu", "__sd", "__lo", "__hi")


def momentum(df: DataFrame, key: str = "coin", day: str = "d", n: int = 20) -> DataFrame:
    """``key``, ``week`` and ``mom``: n-row return sum at the week's last row, carried over weeks without."""
    d = df.withColumn("__m", rolling("sum", F.col("r"), along([key], day), n))
    w = weekly(d, {"__m": last_value("__m", day)}, key, day)
    return w.select(key, "week", forward_fill(F.col("__m"), along([key], "week")).alias("mom"))
