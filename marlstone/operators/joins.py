"""Joins on order and distance, written as equi-joins or one sort so that they scale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, out: str = "matched") -> DataFrame:
    """Add to ``left`` the first ``right_on`` of its key at or after ``left_on``, NULL if there is none.

    Both sides are sorted once per key and the next right value is carried backwards: one shuffle and
    no pairs. Rows of ``left`` with a NULL key or time match nothing and are kept.
    """
    kept = [c for c in left.columns]
    marks = right.select(*keys, F.col(right_on).alias("__t")).filter(F.col("__t").isNotNull()).withColumn("__r", F.col("__t"))
    both = left.withColumns({"__t": F.col(left_on), "__l": F.lit(True)}).unionByName(marks, allowMissingColumns=True)
    ahead = Window.partitionBy(*keys).orderBy(F.col("__t").desc_nulls_first(), F.col("__r").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    found = F.when(F.col("__t").isNotNull(), F.last("__r", ignorenulls=True).over(ahead))
    return both.withColumn(out, found).filter(F.col("__l")).select(*kept, out)


def asof_forward_split(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, out: str = "matched", bucket_days: int = 64) -> DataFrame:
    """``asof_forward`` for keys too large for one task, or none at all: time is cut into buckets of days.

    A row's match lies in its own bucket, or is the first day of the next bucket that has any. The
    latter is looked up between distinct buckets alone, a table as long as the calendar is.
    """
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / bucket_days)
    l = left.withColumn("__b", bucket(F.col(left_on)))  # noqa: E741
    r = right.select(*keys, F.col(right_on).alias("__day")).filter(F.col("__day").isNotNull()).withColumn("__b", bucket(F.col("__day")))
    firsts = r.groupBy(*keys, "__b").agg(F.min("__day").alias("__first"))
    asked = l.select(*keys, "__b").distinct().join(firsts, [*keys, "__b"], "full_outer")
    later = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    following = asked.select(*keys, "__b", F.last("__first", ignorenulls=True).over(later).alias("__next"))
    found = asof_forward(l, r, [*keys, "__b"], left_on, "__day", "__in").join(following, [*keys, "__b"], "left")
    return found.select(*left.columns, F.coalesce("__in", "__next").alias(out))


def trailing_join(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, days: int, aggs: list[Column]) -> DataFrame:
    """Aggregate, per row of ``left``, the right rows of its key dated in ``(left_on - days, left_on]``.

    Dates fall into buckets of ``days``; a window touches two, so every left row meets two buckets
    by an equi-join. ``left`` rows must be distinct; those without a match come out with NULLs.
    """
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / days)
    l = left.withColumn("__b", F.explode(F.array(bucket(F.col(left_on)) - 1, bucket(F.col(left_on)))))  # noqa: E741
    r = right.withColumnRenamed(right_on, "__d").withColumn("__b", bucket(F.col("__d")))
    near = (F.col("__d") > F.date_sub(F.col(left_on), days)) & (F.col("__d") <= F.col(left_on))
    hit = l.join(r, [*keys, "__b"]).filter(near).groupBy(*left.columns).agg(*aggs)
    return left.join(hit, left.columns, "left")


def positional_join(events: DataFrame, rows: DataFrame, keys: list[str], at: str, number: str, offsets: tuple[int, int]) -> DataFrame:
    """Rows of the same key at ``rel`` = offsets[0]..offsets[1] positions from the event's, by an equi-join on the position."""
    e = events.withColumn("rel", F.explode(F.sequence(F.lit(offsets[0]), F.lit(offsets[1]))))
    e = e.withColumn("__n", F.col(at) + F.col("rel"))
    return e.join(rows.withColumnRenamed(number, "__n"), [*keys, "__n"]).drop("__n")


def score_with_cache(df: DataFrame, cache: DataFrame, keys: list[str], score: str, scorer: Callable[[DataFrame], Column]) -> DataFrame:
    """``df`` with ``score`` from ``cache`` where its keys are there, else from ``scorer``; ``cached`` tells which.

    Only misses are scored. The cache must hold a key once; NULL keys are always misses.
    """
    hits = df.join(cache.select(*keys, score), keys).withColumn("cached", F.lit(True))
    misses = df.join(cache, keys, "left_anti")
    return hits.unionByName(misses.withColumn(score, scorer(misses)).withColumn("cached", F.lit(False)))
