"""Queries of projections, filters, sorts, sinks and pluggable scorers, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.scorers import lexicon_model, model_score
from marlstone.functions.text import LEXICON
from marlstone.operators.harness import in_sample, walk_forward
from marlstone.operators.joins import asof_forward_split
from marlstone.operators.metrics import metrics
from marlstone.operators.windows import along, log_return
from marlstone.plans.inference import SPECS, features
from marlstone.plans.relational import _VALUES, _WORDS
from marlstone.plans.series import PX, R6, RET, SENT, prices, r6, returns, sentiment
from marlstone.session import durable, shared_folder
from marlstone.sources.sinks import fixed_width, number, write_csv
from marlstone.sources.tables import table


def q1_project(spark: SparkSession, d: str) -> DataFrame:
    """Column subset, computed column, boolean filter."""
    x = table(spark, d, "lineitem").filter((F.col("l_returnflag") != "N") & F.col("l_quantity").between(10, 40))
    return x.select("l_orderkey", "l_linenumber", *r6(revenue=F.col("l_extendedprice") * (1 - F.col("l_discount"))))


def q4_split(spark: SparkSession, d: str) -> DataFrame:
    """Rows before, from and within dates, both ends of a slice included."""
    x = prices(spark, d)
    return x.groupBy("coin").agg(F.count_if(F.col("d") < "2023-01-01").alias("early"), F.count_if(F.col("d") >= "2023-01-01").alias("late"), F.count_if(F.col("d").between("2022-06-01", "2023-06-01")).alias("inside"))


def q6_dropna(spark: SparkSession, d: str) -> DataFrame:
    """Rows left after dropping by any, all and a subset of NULLs."""
    x = table(spark, d, "sentiment_weekly").select("n_articles", "finbert_linear", "vader_linear")
    parts = [("any", x.na.drop("any")), ("all", x.na.drop("all")), ("subset", x.na.drop(subset=["n_articles"]))]
    made = [p.agg(F.count("*").alias("n")).select(F.lit(n).alias("how"), "n") for n, p in parts]
    return made[0].unionByName(made[1]).unionByName(made[2])


def q9_mask(spark: SparkSession, d: str) -> DataFrame:
    """Assignment under a mask and a three-way label whose upper tail wins."""
    x = returns(spark, d)
    label = F.when(F.col("r") >= 0.02, 1).when(F.col("r") <= -0.02, -1).otherwise(0)
    return x.select("coin", "d", label.alias("label"), *r6(capped=F.when(F.abs("r") > 0.05, F.signum("r") * 0.05).otherwise(F.col("r"))))


def q11_reindex(spark: SparkSession, d: str) -> DataFrame:
    """Sentiment looked up on every trading day of the coin, NULL where it has none."""
    s = sentiment(spark, d).withColumnRenamed("week", "d")
    return prices(spark, d).join(s, ["coin", "d"], "left").select("coin", "d", "n", *r6(s=F.col("s")))


def q12_onehot(spark: SparkSession, d: str) -> DataFrame:
    """Indicators of all but the first segment."""
    c = table(spark, d, "customer")
    return c.select("c_custkey", *[(F.col("c_mktsegment") == s).cast("double").alias(f"is_{s.lower()}") for s in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])


def o1_sorted(spark: SparkSession, d: str) -> DataFrame:
    """The twenty days of the largest moves over all coins, best first (O1 to O3)."""
    return returns(spark, d).filter("r is not null").select("coin", "d", *r6(r=F.col("r"))).orderBy(F.desc("r"), "coin", "d").limit(20)


def s12_events(spark: SparkSession, d: str) -> DataFrame:
    """A literal table of named dates and each one's first trading day."""
    named = spark.createDataFrame([("spring", "1996-03-02", "-"), ("harvest", "1997-09-06", "+"), ("new year", "1999-01-01", "-"), ("leap day", "2000-02-29", "+"), ("after", "2031-01-01", "-")], "name string, day string, sign string").withColumn("day", F.to_date("day"))
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return asof_forward_split(named, days, [], "day", "d", "t0").select("name", "sign", "day", "t0")


def s5_ohlc(spark: SparkSession, d: str) -> DataFrame:
    """Daily open, high, low and close of each segment, the typical price and its log return."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("ticker")), "o_custkey")
    at = F.struct("o_orderdate", "o_orderkey")
    x = o.groupBy("ticker", F.to_date("o_orderdate").alias("d")).agg(F.min_by("o_totalprice", at).alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", at).alias("close"))
    x = x.withColumn("typical", (F.col("high") + F.col("low") + F.col("close")) / 3)
    return x.select("ticker", "d", "open", "high", "low", "close", *r6(typical=F.col("typical"), r=log_return(F.col("typical"), along(["ticker"], "d"))))


def k1_csv(spark: SparkSession, d: str) -> DataFrame:
    """A result written as CSV and read back."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    write_csv(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return spark.read.schema("s_suppkey BIGINT, s_name STRING, s_acctbal DOUBLE").option("header", True).csv(path)


def k2_report(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a fixed-width report."""
    x = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.max("s_acctbal").alias("top"))
    return x.select(fixed_width((F.col("s_nationkey").cast("string"), 4), (F.col("n").cast("string"), 6), (number(F.col("top"), 2), 12)).alias("line"))


def x3_model(spark: SparkSession, d: str) -> DataFrame:
    """Scores by a model held in the workers (softmax of its logits, F15)."""
    return table(spark, d, "documents").select("doc_id", *r6(score=model_score(F.col("text"), lexicon_model(LEXICON))))


def v9_optimism(spark: SparkSession, d: str) -> DataFrame:
    """AUC of each spec's model on the rows it was fitted to, against the walk-forward one (half-life 104), by spec."""
    x = durable(features(spark, d))
    forward = metrics(durable(walk_forward(x, "asset", "week", SPECS, (104.0,), known="known")), ["spec"]).select("spec", F.col("auc").alias("auc_forward"))
    inside = metrics(in_sample(x, "asset", "week", SPECS), ["spec"]).select("spec", F.col("auc").alias("auc_inside"))
    return inside.join(forward, "spec").withColumn("optimism", F.col("auc_inside") - F.col("auc_forward"))


def v10_pilot(spark: SparkSession, d: str) -> DataFrame:
    """Distance of two scorers' means by coin against a bound."""
    x = table(spark, d, "sentiment_weekly").filter("finbert_linear is not null and vader_linear is not null").groupBy("coin").agg(F.abs(F.avg("finbert_linear") - F.avg("vader_linear")).alias("gap"))
    return x.select("coin", F.when(F.col("gap") < 0.15, "within").otherwise("beyond").alias("verdict"), *r6(gap=F.col("gap")))


QUERIES = {f.__name__: f for f in (q1_project, q4_split, q6_dropna, q9_mask, q11_reindex, q12_onehot, o1_sorted, s5_ohlc, s12_events, k1_csv, k2_report, x3_model, v9_optimism, v10_pilot)}
_SOFTMAX = f"""WITH h AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '\\b({_WORDS})\\b', 1), lambda w: {_VALUES}[w]) AS v FROM documents),
l AS (SELECT doc_id, coalesce(list_sum(list_filter(v, lambda x: x > 0)), 0) AS p, -coalesce(list_sum(list_filter(v, lambda x: x < 0)), 0) AS n FROM h), t AS (SELECT *, greatest(p, n, 0) AS top FROM l)
SELECT doc_id, {R6('(exp(p - top) - exp(n - top)) / (exp(p - top) + exp(n - top) + exp(-top))')} AS score FROM t"""
SQL = {
    "q1_project": f"SELECT l_orderkey, l_linenumber, {R6('l_extendedprice * (1 - l_discount)')} AS revenue FROM lineitem WHERE l_returnflag <> 'N' AND l_quantity BETWEEN 10 AND 40",
    "q4_split": f"WITH {PX} SELECT coin, count(*) FILTER (WHERE d < '2023-01-01') AS early, count(*) FILTER (WHERE d >= '2023-01-01') AS late, count(*) FILTER (WHERE d BETWEEN '2022-06-01' AND '2023-06-01') AS inside FROM px GROUP BY coin",
    "q6_dropna": "SELECT 'any' AS how, count(*) AS n FROM sentiment_weekly WHERE n_articles IS NOT NULL AND finbert_linear IS NOT NULL AND vader_linear IS NOT NULL UNION ALL SELECT 'all', count(*) FROM sentiment_weekly WHERE NOT (n_articles IS NULL AND finbert_linear IS NULL AND vader_linear IS NULL) UNION ALL SELECT 'subset', count(*) FROM sentiment_weekly WHERE n_articles IS NOT NULL",
    "q9_mask": f"WITH {RET} SELECT coin, d, CASE WHEN r >= 0.02 THEN 1 WHEN r <= -0.02 THEN -1 ELSE 0 END AS label, {R6('CASE WHEN abs(r) > 0.05 THEN sign(r) * 0.05 ELSE r END')} AS capped FROM ret",
    "q11_reindex": f"WITH {PX}, {SENT} SELECT px.coin, px.d, sen.n, {R6('sen.s')} AS s FROM px LEFT JOIN sen ON sen.coin = px.coin AND sen.week = px.d",
    "q12_onehot": "SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{s}' AS DOUBLE) AS is_{s.lower()}" for s in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer",
    "o1_sorted": f"WITH {RET} SELECT coin, d, {R6('r')} AS r FROM ret WHERE r IS NOT NULL ORDER BY 3 DESC, coin, d LIMIT 20",
    "s12_events": "WITH n(name, day, sign) AS (VALUES ('spring', DATE '1996-03-02', '-'), ('harvest', DATE '1997-09-06', '+'), ('new year', DATE '1999-01-01', '-'), ('leap day', DATE '2000-02-29', '+'), ('after', DATE '2031-01-01', '-')), o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT name, sign, day, o.d AS t0 FROM n ASOF LEFT JOIN o ON n.day <= o.d",
    "s5_ohlc": f"WITH b AS (SELECT c_mktsegment AS ticker, CAST(o_orderdate AS DATE) AS d, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL), t AS (SELECT *, (high + low + close) / 3 AS tp FROM b) SELECT ticker, d, open, high, low, close, {R6('tp')} AS typical, {R6('ln(tp) - lag(ln(tp)) OVER (PARTITION BY ticker ORDER BY d)')} AS r FROM t",
    "k1_csv": "SELECT s_suppkey, s_name, s_acctbal FROM supplier",
    "k2_report": "SELECT lpad(CAST(s_nationkey AS VARCHAR), 4, ' ') || ' ' || lpad(CAST(count(*) AS VARCHAR), 6, ' ') || ' ' || lpad(CAST(CAST(max(s_acctbal) AS DECIMAL(20,2)) AS VARCHAR), 12, ' ') AS line FROM supplier GROUP BY s_nationkey",
    "x3_model": _SOFTMAX,
    "v10_pilot": f"SELECT coin, CASE WHEN g < 0.15 THEN 'within' ELSE 'beyond' END AS verdict, {R6('g')} AS gap FROM (SELECT coin, abs(avg(finbert_linear) - avg(vader_linear)) AS g FROM sentiment_weekly WHERE finbert_linear IS NOT NULL AND vader_linear IS NOT NULL GROUP BY coin)",
}
