"""Records of several sources in given shares of the total size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.tokens import n_tokens
from marlstone.session import durable, small_side

#: Rows that one bucket of a source's random order should hold; a bucket is sorted in one task.
BUCKET_ROWS = 20_000


def plan_budgets(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """``source``, ``target_share``, ``max_repeats``, ``size`` and ``budget`` in tokens, one row per listed source.

    Without ``total_tokens`` the total is the largest at which every listed source that has
    documents still reaches its share within its repeats. A source's budget never exceeds its size
    times its repeats. Listed twice, a source's shares add up and the larger repeats hold.
    """
    t = targets.filter(F.col("source").isNotNull() & (F.col("target_share") > 0)).groupBy("source").agg(F.sum("target_share").alias("target_share"), F.greatest(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
    both = t.join(sizes, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    room = F.col("size") * F.col("max_repeats")
    if total_tokens is None:
        both = both.withColumn("__t", F.min(F.when(room > 0, room / F.col("target_share"))).over(Window.partitionBy()))
    else:
        both = both.withColumn("__t", F.lit(float(total_tokens)))
    return both.withColumn("budget", F.least(room.cast("double"), F.coalesce("__t", F.lit(0.0)) * F.col("target_share"))).drop("__t")


def mix_sources(df: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total_tokens: int | None = None, seed: int = 1, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(chosen, report)``: ``key``, ``source``, ``tokens``, ``repeats`` (times used, at least 1), and shares reached.

    Documents of NULL or unlisted sources and without tokens take no part. Each source's documents
    stand in a random order by hash; whole rounds through all of them come first, then the order's
    prefix whose size comes nearest to what is left of the budget.

    The order is cut into buckets of the hash, so the running size is the sum of the buckets before
    (a small table) plus a running sum inside one bucket; only the bucket that holds a source's cut
    is sorted at all. A source of a third of all rows has a third of the buckets.
    """
    docs = df.filter(F.col(source).isNotNull()).select(F.col(key).alias("__k"), F.col(source).alias("source"), n_tokens(F.col(text), tokenizer).alias("tokens"))
    listed = targets.filter("target_share > 0").select("source").distinct()
    docs = durable(docs.filter("tokens > 0").join(listed, "source", "left_semi").withColumn("__u", F.monotonically_increasing_id()))
    buckets = max(16, -(-docs.count() // BUCKET_ROWS))
    order = F.xxhash64("__u", F.lit(seed))
    docs = docs.withColumns({"__o": order, "__b": F.floor((order.cast("double") + 2.0**63) / (2.0**64 / buckets)).cast("int")})
    sums = durable(docs.groupBy("source", "__b").agg(F.sum("tokens").alias("__s")))
    plan = durable(plan_budgets(sums.groupBy("source").agg(F.sum("__s").alias("size")), targets, total_tokens))
    before = F.sum("__s").over(Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    full = F.when(F.col("size") > 0, F.floor(F.col("budget") / F.col("size"))).otherwise(0)
    cuts = sums.join(plan.select("source", "size", "budget", "max_repeats"), "source").select("source", "__b", F.coalesce(before, F.lit(0)).alias("__before"), "__s", full.cast("int").alias("__full"), (F.col("budget") - full * F.col("size")).alias("__rest"))
    docs = docs.join(small_side(durable(cuts)), ["source", "__b"])
    inside = docs.filter((F.col("__before") < F.col("__rest")) & (F.col("__before") + F.col("__s") > F.col("__rest")))
    running = F.sum("tokens").over(Window.partitionBy("source", "__b").orderBy("__o", "__u").rowsBetween(Window.unboundedPreceding, 0)) + F.col("__before")
    nearest = running - F.col("tokens") / 2 <= F.col("__rest")
    cut = inside.select("__k", "source", "tokens", (F.col("__full") + nearest.cast("int")).alias("repeats"))
    whole = docs.filter(~((F.col("__before") < F.col("__rest")) & (F.col("__before") + F.col("__s") > F.col("__rest"))))
    whole = whole.select("__k", "source", "tokens", (F.col("__full") + (F.col("__before") + F.col("__s") <= F.col("__rest")).cast("int")).alias("repeats"))
    chosen = durable(whole.unionByName(cut).filter("repeats > 0"))
    got = chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    everything = F.sum("tokens").over(Window.partitionBy())
    report = plan.join(got, "source", "left").withColumn("__all", everything)
    report = report.select("source", "target_share", "max_repeats", F.col("size").alias("size_tokens"), F.col("budget").alias("budget_tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("__all"), F.lit(0.0)).alias("reached_share"))
    return chosen.select(F.col("__k").alias(key), "source", "tokens", "repeats"), report
