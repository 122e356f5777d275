"""Weekly composites over an unbounded stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def weekly_stream(df: DataFrame, ts: str, key: str, value: str, late: str = "14 days") -> DataFrame:
    """Count and mean of ``value`` per key and week ending on a Friday.

    Works on batch and streaming frames alike. Weeks begin on Saturday, two days after the epoch's
    Thursday. In a stream a week is closed, and its state dropped, once the newest event is ``late``
    past its end; rows of closed weeks are dropped.
    """
    d = df.withColumn(ts, F.col(ts).cast("timestamp"))
    d = d.withWatermark(ts, late) if d.isStreaming else d
    g = d.groupBy(F.window(ts, "7 days", startTime="2 days").alias("w"), F.col(key))
    return g.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")).select(F.date_sub(F.to_date("w.end"), 1).alias("week"), key, "n", "total", "mean")


def run_available(spark: SparkSession, source: str, schema, folder: str, ts: str, key: str, value: str, late: str = "14 days") -> DataFrame:
    """Read all that ``source`` (a path of parquet files) holds as a stream into ``folder`` and return the result.

    ``update`` mode: every batch writes the weeks it changed, under its own number so that a batch
    that is run again after a failure replaces what it wrote; of a week the newest batch counts.
    The state holds open weeks only, and a later call reads just the files that came since.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/part={number}")

    stream = weekly_stream(spark.readStream.schema(schema).parquet(source), ts, key, value, late)
    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    made = spark.read.parquet(f"{folder}/out")
    newest = F.max_by(F.struct("n", "total", "mean"), "batch").alias("__b")
    return made.groupBy("week", key).agg(newest).select("week", key, "__b.n", "__b.total", "__b.mean")
