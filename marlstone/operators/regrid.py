"""Irregular readings onto a regular weekly grid, with missed cells marked and filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.calendar import week_end
from marlstone.operators.trailing import latest_readings


def regrid_weekly(df: DataFrame, entity: str, day: str, amount: str, level: str | None = None, loaded: str | None = None, cumulative: bool = False, cover_days: int = 7) -> DataFrame:
    """One row per entity and week ending on a Friday, from its first to its last reading.

    Result: ``entity``, ``week``, ``readings`` (dated in the week), ``covered_days``, ``amount``
    (NULL where nothing covers the week), ``level`` (overlap-weighted mean), ``level_filled`` (the
    last known level carried on), ``status``: ``observed`` (a reading is dated in the week),
    ``apportioned`` (none is, but a later reading's period reaches into it) or ``uncovered``.

    A reading's increment belongs to the days after the previous reading, at most ``cover_days``
    of them, up to its own date, and is shared out over the weeks by overlap. ``amount`` is taken
    as increments, or with ``cumulative=True`` as a counter: consecutive readings are differenced,
    a fall is a reset (the new value is the increment), and the first reading has no increment.
    The first reading's period begins with its own week, so that increments sum to the input's.
    NULL amounts are no readings; for repeats of one day the latest loaded counts; rows without
    entity or date are left out; an empty table gives an empty grid.

    One sort by entity; an entity has at most one reading a day, however often it was delivered.
    """
    r = latest_readings(df, entity, day, [amount, level or amount], loaded)
    w = Window.partitionBy("__e").orderBy("__day")
    prev, before = F.lag("__day").over(w), F.lag("__v0").over(w)
    step: Column = F.col("__v0")
    if cumulative:
        step = F.when(before.isNull(), None).when(F.col("__v0") < before, F.col("__v0")).otherwise(F.col("__v0") - before)
    own = week_end(F.col("__day"))
    r = r.withColumns({"__step": step, "__from": F.greatest(F.coalesce(prev, F.date_sub(own, 7)), F.date_sub("__day", cover_days))})
    cells = r.select("__e", "__day", "__step", "__v1", "__from", F.explode(F.sequence(week_end(F.date_add("__from", 1)), own, F.expr("interval 7 days"))).alias("__week"))
    overlap = F.datediff(F.least("__day", "__week"), F.greatest("__from", F.date_sub("__week", 7)))
    length = F.datediff("__day", "__from")
    cells = cells.withColumns({"__o": overlap, "__share": F.col("__step") * overlap / length, "__here": (week_end(F.col("__day")) == F.col("__week")).cast("int")})
    has_level = F.col("__v1").isNotNull()
    sums = cells.groupBy("__e", "__week").agg(
        F.sum("__here").alias("readings"), F.sum("__o").alias("covered_days"), F.sum("__share").alias("amount"),
        (F.sum(F.when(has_level, F.col("__v1") * F.col("__o"))) / F.sum(F.when(has_level, F.col("__o")))).alias("level"),
    )
    spine = r.groupBy("__e").agg(F.min(own).alias("__a"), F.max(own).alias("__b")).select("__e", F.explode(F.sequence("__a", "__b", F.expr("interval 7 days"))).alias("__week"))
    g = spine.join(sums, ["__e", "__week"], "left")
    known = Window.partitionBy("__e").orderBy("__week").rowsBetween(Window.unboundedPreceding, 0)
    status = F.when(F.coalesce("readings", F.lit(0)) > 0, "observed").when(F.col("covered_days") > 0, "apportioned").otherwise("uncovered")
    out = g.select(
        F.col("__e").alias("entity"), F.col("__week").alias("week"), F.coalesce("readings", F.lit(0)).alias("readings"), F.coalesce("covered_days", F.lit(0)).alias("covered_days"),
        F.col("amount"), F.col("level"), F.last("level", ignorenulls=True).over(known).alias("level_filled"), status.alias("status"),
    )
    return out if level else out.drop("level", "level_filled")
