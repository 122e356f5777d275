"""Ordered operators on series in long form; every window is partitioned by the series' key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marlstone.session import durable


def along(keys: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def log_return(level: Column, w: WindowSpec) -> Column:
    """Difference of logs to the row before (a row lag, not a calendar lag)."""
    return F.ln(level) - F.lag(F.ln(level)).over(w)


def rolling(agg: str, x: Column, w: WindowSpec, n: int, min_periods: int | None = None) -> Column:
    """Aggregate over the last ``n`` rows, NULL below ``min_periods`` (default ``n``) values."""
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(frame) >= (min_periods or n), getattr(F, agg)(x).over(frame))


def rolling_weighted_mean(x: Column, weight: Column, w: WindowSpec, n: int = 4, min_periods: int = 2) -> Column:
    """Sum of x * weight over sum of weight, each with its own guard."""
    return rolling("sum", x * weight, w, n, min_periods) / rolling("sum", weight, w, n, min_periods)


def forward_fill(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def running_sum(x: Column, w: WindowSpec) -> Column:
    return F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def running_product(growth: Column, w: WindowSpec) -> Column:
    """Product of ``1 + growth`` so far, for growth above -1."""
    return F.exp(F.sum(F.log1p(growth)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def rows_until(level: Column, target: Column, w: WindowSpec, horizon: int) -> Column:
    """Rows ahead to the first level at or above ``target``, at most ``horizon``; NULL if there is none."""
    ahead = F.collect_list(level).over(w.rowsBetween(1, horizon))
    at = F.array_position(F.transform(ahead, lambda x: x >= target), F.lit(True))
    return F.when(at > 0, at)


def average_rank(x: Column, keys: list[str]) -> Column:
    """Rank from 1 with ties sharing the mean of their places."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2


def sorted_codes(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """The distinct values of ``column`` with their number in sorted order, from 0; NULL, if there, comes first.

    The values are cut into ranges; a number is the count of the ranges before (a row a range) plus
    the place inside its own range, so no task sorts them all.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = durable(df.select(column).distinct().repartitionByRange(ranges, column).withColumn("__part", F.spark_partition_id()))
    sizes = cut.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__part", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(column)) - 1
    return cut.withColumn("__k", place).join(sizes, "__part").select(column, (F.col("__before") + F.col("__k")).cast("int").alias(out))


def gap_clusters(df: DataFrame, keys: list[str], day: str, gap_days: int, out: str = "cluster_id") -> DataFrame:
    """Number runs of rows whose distance to the row before is at most ``gap_days``, from 1 per key."""
    w = along(keys, day)
    new = F.coalesce((F.datediff(F.col(day), F.lag(day).over(w)) > gap_days).cast("int"), F.lit(1))
    return df.withColumn("__new", new).withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int | Column) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__rn") <= k).drop("__rn")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``, chosen by an aggregate that combines before the shuffle."""
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), rank)
    return df.groupBy(*keys).agg(best.alias("__b")).select(*keys, *[F.col(f"__b.`{c}`") for c in rest])
