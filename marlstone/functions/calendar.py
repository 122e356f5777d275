"""Calendar periods and spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def week_end(d: Column) -> Column:
    """The Friday that ends the week of ``d`` (Saturday to Friday); a Friday is its own."""
    return F.date_add(d, F.pmod(F.lit(6) - F.dayofweek(d), F.lit(7)))


def month_end(d: Column) -> Column:
    return F.last_day(d)


def spine(df: DataFrame, d: str, keys: list[str] | None = None, step: str = "7 days", out: str = "period") -> DataFrame:
    """Every period from the first to the last ``d`` (per ``keys`` if given), gaps included."""
    keys = keys or []
    b = df.groupBy(*keys).agg(F.min(d).alias("__a"), F.max(d).alias("__b")).filter(F.col("__a").isNotNull())
    return b.select(*keys, F.explode(F.sequence("__a", "__b", F.expr(f"interval {step}"))).alias(out))


def periods(start: str, end: str, months: int = 1) -> Column:
    """Array of half-open ``{first, next}`` month (or quarter, ``months=3``) periods from start to end."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    firsts = F.sequence(F.trunc(a, "month"), b, F.expr(f"interval {months} month"))
    return F.transform(firsts, lambda x: F.struct(x.alias("first"), F.add_months(x, months).alias("next")))
