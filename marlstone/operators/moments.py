"""Written dates of a table with sources, as one unambiguous form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.timestamps import known_zone, parse_dates


def source_rules(sources: DataFrame) -> DataFrame:
    """One row per source: ``__src``, ``__tz`` (NULL unless a known zone) and ``__order``."""
    return (
        sources.filter(F.col("source").isNotNull())
        .groupBy(F.col("source").alias("__src"))
        .agg(F.min(known_zone(F.col("tz_name"))).alias("__tz"), F.min("day_order").alias("__order"))
    )


def host_source(url: Column) -> Column:
    """The site of a URL without ``www.`` or ``m.``, in lower case; NULL if there is none."""
    host = F.regexp_extract(F.lower(url), r"^\s*[a-z]+://+(?:www\.|m\.)?([^/?#:\s]+)", 1)
    return F.when(host != "", host)


def normalise_dates(df: DataFrame, sources: DataFrame, date: str = "date", source: Column | None = None, out: str = "ts") -> DataFrame:
    """``parse_dates`` under each row's source: its zone for times without one, its day order.

    Rows of a NULL or unlisted source are kept and read as UTC, day first. The table of sources is
    joined without a hint: Catalyst broadcasts it while it is small and shuffles otherwise.
    """
    source = F.col("source") if source is None else source
    d = df.withColumn("__key", source)
    d = d.join(source_rules(sources), F.col("__key") == F.col("__src"), "left")
    d = parse_dates(d, date, F.col("__tz"), F.col("__order"), out)
    return d.drop("__key", "__src", "__tz", "__order")
