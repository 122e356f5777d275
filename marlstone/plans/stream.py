"""The streaming composite as a query."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans.series import R6, r6
from marlstone.session import shared_folder
from marlstone.sources.tables import table
from marlstone.streaming.weekly import run_available


def st_weekly(spark: SparkSession, d: str) -> DataFrame:
    """Weekly totals of events by type, read as a stream."""
    x = run_available(spark, f"{d}/events.parquet*", table(spark, d, "events").schema, f"{shared_folder(spark)}/{uuid.uuid4().hex}", "ts", "event_type", "value")
    return x.select("week", "event_type", F.col("n"), *r6(total=F.round("total", 4), mean=F.col("mean")))


QUERIES = {"st_weekly": st_weekly}
SQL = {"st_weekly": f"SELECT CAST(CAST(ts AS DATE) + CAST((5 - dayofweek(ts) + 7) % 7 AS INTEGER) AS DATE) AS week, event_type, count(*) AS n, {R6('round(sum(value), 4)')} AS total, {R6('avg(value)')} AS mean FROM events GROUP BY ALL"}
