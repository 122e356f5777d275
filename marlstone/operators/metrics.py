"""Scores of probabilistic predictions, as aggregates and windows; labels 0/1 in ``y``, scores in ``p``."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import durable


def by_score(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and positives per distinct score: all that the rank metrics need, combined before the shuffle."""
    return df.filter("y is not null and p is not null").groupBy(*keys, "p").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))


def ranked(df: DataFrame, keys: list[str]) -> DataFrame:
    """``by_score`` with ``tp`` and ``seen`` (positives and rows at this score or above), ``events`` and ``all`` of the key.

    Distinct scores are cut into ranges of about equal size; what lies above a row is the sum of the
    ranges above (a table as long as there are keys and ranges) plus a running sum inside its own.
    So a key of any number of distinct scores spreads over many tasks.
    """
    ranges = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    cut = by_score(df, keys).repartitionByRange(int(ranges), *keys, F.desc("p")).withColumn("__part", F.spark_partition_id())
    cut = durable(cut)
    whole = Window.partitionBy(*keys)
    above = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, "__part").agg(F.sum("pos").alias("__pos"), F.sum("n").alias("__n"))
    sums = sums.select(
        *[F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)], F.col("__part").alias("__p"), F.coalesce(F.sum("__pos").over(above), F.lit(0)).alias("__tp"), F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__seen"),
        F.sum("__pos").over(whole).alias("events"), F.sum("__n").over(whole).alias("all"),
    )
    inside = Window.partitionBy(*keys, "__part").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    g = cut.withColumns({"__a": F.sum("pos").over(inside), "__b": F.sum("n").over(inside)})
    same = [F.col(k).eqNullSafe(F.col(f"__k{j}")) for j, k in enumerate(keys)]
    g = g.join(sums, functools.reduce(lambda a, b: a & b, same, F.col("__part") == F.col("__p")))
    return g.select(*keys, "p", "n", "pos", (F.col("__tp") + F.col("__a")).alias("tp"), (F.col("__seen") + F.col("__b")).alias("seen"), "events", "all")


def _ratio(a: Column, b: Column) -> Column:
    return a / F.when(b > 0, b)


def metrics(df: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Per key: n, events, auc (ties count half), average precision by steps, Brier score, precision and recall at the threshold and at K = events.

    AUC and the step metrics are NULL without both classes. At K, ties are cut in proportion: a
    score group that straddles K counts the expected positives of its share, whatever the row order.
    """
    g = ranked(df, keys)
    neg = F.col("n") - F.col("pos")
    below = F.col("all") - F.col("events") - (F.col("seen") - F.col("tp"))  # negatives with a lower score
    before = F.col("seen") - F.col("n")
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.col("events") - before))
    both = (F.col("events") > 0) & (F.col("events") < F.col("all"))
    at = F.col("p") >= threshold
    out = g.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("events"),
        F.sum(F.when(both, F.col("pos") * (below + neg / 2) / (F.col("events") * (F.col("all") - F.col("events"))))).alias("auc"),
        F.sum(F.when(F.col("events") > 0, F.col("pos") / F.col("events") * F.col("tp") / F.col("seen"))).alias("average_precision"),
        (F.sum(F.col("pos") * (1 - F.col("p")) * (1 - F.col("p")) + neg * F.col("p") * F.col("p")) / F.sum("n")).alias("brier"),
        F.coalesce(_ratio(F.sum(F.when(at, F.col("pos"))), F.sum(F.when(at, F.col("n")))), F.lit(0.0)).alias("precision"),
        F.coalesce(_ratio(F.coalesce(F.sum(F.when(at, F.col("pos"))), F.lit(0)), F.sum("pos")), F.lit(0.0)).alias("recall"),
        F.coalesce(_ratio(F.sum(taken * F.col("pos") / F.col("n")), F.sum("pos")), F.lit(0.0)).alias("precision_at_k"),
    )
    return out


def roc_points(df: DataFrame, keys: list[str]) -> DataFrame:
    """False and true positive rate from each distinct score down."""
    g = ranked(df, keys)
    return g.select(*keys, "p", _ratio(F.col("seen") - F.col("tp"), F.col("all") - F.col("events")).alias("fpr"), _ratio(F.col("tp"), F.col("events")).alias("tpr"))
