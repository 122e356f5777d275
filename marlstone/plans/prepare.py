"""Queries of the record-preparation operators: failing rows, trailing totals, dates, weekly grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.moments import host_source, normalise_dates
from marlstone.operators.records import is_blank, load_records
from marlstone.operators.regrid import regrid_weekly
from marlstone.operators.trailing import latest_readings, trailing_totals
from marlstone.operators.windows import along, running_sum
from marlstone.plans import records_sql
from marlstone.sources.tables import table


def settled(c: Column) -> Column:
    """Six decimals; the nudge settles exact halves, whatever the order of summation left of them."""
    return F.round(c + 2e-9, 6)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are no valid date-and-text record, with the first reason that applies."""
    return load_records(table(spark, d, "articles_raw"))[1].select("line_id", "reason")


def p2_valid(spark: SparkSession, d: str) -> DataFrame:
    """The records that load."""
    return load_records(table(spark, d, "articles_raw"))[0].select("line_id", "source", "date", F.length("text").alias("text_chars"))


def p3_prices(spark: SparkSession, d: str) -> DataFrame:
    t = trailing_totals(table(spark, d, "panel_prices"), "coin", "date", ["close"], loaded="loaded_at")
    return t.select(F.col("entity").alias("coin"), "day", "days_7", "days_30", *[settled(F.col(f"close_{f}_{s}")).alias(f"close_{f}_{s}") for s in (7, 30) for f in ("sum", "avg")])


def p3_sentiment(spark: SparkSession, d: str) -> DataFrame:
    t = trailing_totals(table(spark, d, "sentiment_weekly"), "coin", "week", ["n_articles", "finbert_exp_hl7"], loaded="loaded_at")
    columns = [f"{v}_{f}_{s}" for s in (7, 30) for v in ("n_articles", "finbert_exp_hl7") for f in ("sum", "avg")]
    return t.select(F.col("entity").alias("coin"), "day", "days_7", "days_30", *[settled(F.col(c)).alias(c) for c in columns])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Coin-days without any activity in the trailing window."""
    parts = []
    for name, day, value in (("panel_prices", "date", "close"), ("sentiment_weekly", "week", "n_articles")):
        t = trailing_totals(table(spark, d, name), "coin", day, [value], loaded="loaded_at")
        span = F.explode(F.filter(F.array(*[F.struct(F.lit(s).alias("span"), F.col(f"days_{s}").alias("n")) for s in (7, 30)]), lambda x: x["n"] == 0)).alias("w")
        parts.append(t.select(F.lit(name).alias("tbl"), F.col("entity").alias("coin"), F.col("day").cast("string").alias("day_text"), span))
    return parts[0].unionByName(parts[1]).select("tbl", "coin", "day_text", F.col("w.span").alias("span"))


def p5_all(spark: SparkSession, d: str) -> DataFrame:
    """Every record's date in the one form; ``kind`` tells what could not be read and why."""
    sources = table(spark, d, "sources")
    scraped = normalise_dates(table(spark, d, "articles_scraped").select("article_id", "date", "source", "url"), sources, source=F.coalesce("source", host_source(F.col("url"))))
    failed = load_records(table(spark, d, "articles_raw"))[1].select(F.col("line_id").alias("__failed"))
    lines = table(spark, d, "articles").filter(~(is_blank(F.col("date")) & is_blank(F.col("text")))).select("line_id", "date", "source")
    lines = lines.join(failed, F.col("line_id") == F.col("__failed"), "left_anti")
    parts = [
        scraped.select(F.lit("articles_scraped").alias("tbl"), F.col("article_id").alias("row_id"), "date", "ts_kind", "ts_text"),
        normalise_dates(lines, sources).select(F.lit("articles").alias("tbl"), F.col("line_id").alias("row_id"), "date", "ts_kind", "ts_text"),
    ]
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose date is not yet in the one form, with the form it must take."""
    return p5_all(spark, d).filter(F.col("ts_text").isNotNull() & (F.col("ts_text") != F.col("date"))).select("tbl", "row_id", F.col("ts_text").alias("utc_text"))


def p6_grid(spark: SparkSession, d: str) -> DataFrame:
    g = regrid_weekly(table(spark, d, "sentiment_weekly"), "coin", "week", "n_articles", "finbert_exp_hl7", "loaded_at")
    return g.select(F.col("entity").alias("coin"), "week", "readings", "covered_days", settled(F.col("amount")).alias("n_articles"), settled(F.col("level")).alias("finbert_exp_hl7"), settled(F.col("level_filled")).alias("finbert_filled"), "status")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Weeks without a reading, by way of the running number of articles and its differences."""
    g = regrid_weekly(counter(spark, d), "coin", "week", "total", "finbert_exp_hl7", cumulative=True)
    return g.filter("readings = 0").select(F.col("entity").alias("coin"), F.col("week").cast("string").alias("week_text"))


#: The counter of ``p6_counter`` starts again when it would pass this number.
COUNTER_WRAPS = 1000


def counter(spark: SparkSession, d: str) -> DataFrame:
    """``n_articles`` as a meter would deliver it: the coin's running number of articles, which starts again after COUNTER_WRAPS."""
    clean = latest_readings(table(spark, d, "sentiment_weekly"), "coin", "week", ["n_articles", "finbert_exp_hl7"], "loaded_at")
    total = running_sum(F.col("__v0"), along(["__e"], "__day"))
    return clean.select(F.col("__e").alias("coin"), F.col("__day").alias("week"), (total % COUNTER_WRAPS).alias("total"), F.col("__v1").alias("finbert_exp_hl7"))


def p6_counter(spark: SparkSession, d: str) -> DataFrame:
    """The grid from a cumulative counter with resets: differences of consecutive readings, shared out by overlap."""
    g = regrid_weekly(counter(spark, d), "coin", "week", "total", "finbert_exp_hl7", cumulative=True)
    return g.select(F.col("entity").alias("coin"), "week", "readings", "covered_days", settled(F.col("amount")).alias("n_articles"), "status")


_LATEST = """
  SELECT coin, {day} AS d, arg_max(v0, (loaded_at, v0)) AS v0, arg_max(coalesce(v1, 'NaN'::DOUBLE), (loaded_at, v0)) AS v1
  FROM (SELECT coin, {day}, CAST({v0} AS DOUBLE) v0, CAST({v1} AS DOUBLE) v1, loaded_at FROM {tbl}) WHERE v0 IS NOT NULL AND coin IS NOT NULL AND {day} IS NOT NULL
  GROUP BY coin, {day}"""


def _latest(tbl: str, day: str, v0: str, v1: str) -> str:
    return f"r AS (SELECT coin, d, v0, CASE WHEN isnan(v1) THEN NULL ELSE v1 END AS v1 FROM ({_LATEST.format(tbl=tbl, day=day, v0=v0, v1=v1)}))"


_DAYS = "days AS (SELECT coin, CAST(unnest(generate_series(min(d)::TIMESTAMP, max(d)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM r GROUP BY coin)"


def _spans(columns: dict[str, str]) -> str:
    made = []
    for s in (7, 30):
        cond = f"FILTER (WHERE r.d > days.day - {s})"
        made.append(f"CAST(count(r.v0) {cond} AS INTEGER) AS days_{s}")
        for name, v in columns.items():
            made += [f"round(sum(r.{v}) {cond} + 2e-9, 6) AS {name}_sum_{s}", f"round(avg(r.{v}) {cond} + 2e-9, 6) AS {name}_avg_{s}"]
    return ", ".join(made)


def _trailing_sql(tbl: str, day: str, v0: str, v1: str, columns: dict[str, str]) -> str:
    return f"WITH {_latest(tbl, day, v0, v1)}, {_DAYS} SELECT days.coin, days.day, {_spans(columns)} FROM days LEFT JOIN r ON r.coin = days.coin AND r.d <= days.day AND r.d > days.day - 30 GROUP BY days.coin, days.day"


def _gap_sql(tbl: str, day: str, v0: str) -> str:
    return f"""SELECT '{tbl}' AS tbl, coin, CAST(day AS VARCHAR) AS day_text, CAST(span AS INTEGER) AS span FROM
      (WITH r AS (SELECT DISTINCT coin, {day} AS d FROM {tbl} WHERE {v0} IS NOT NULL), {_DAYS}
       SELECT days.coin, days.day, s.span FROM days CROSS JOIN (VALUES (7), (30)) s(span)
       WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.coin = days.coin AND r.d <= days.day AND r.d > days.day - s.span))"""


_FRIDAY = "CAST({0} + CAST((5 - dayofweek({0}) + 7) % 7 AS INTEGER) AS DATE)"
_GRID = f"""
WITH {_latest("sentiment_weekly", "week", "n_articles", "finbert_exp_hl7")},
i AS (SELECT coin, d, v0, v1, {_FRIDAY.format("d")} AS own, lag(d) OVER (PARTITION BY coin ORDER BY d) AS p FROM r),
f AS (SELECT *, greatest(coalesce(p, CAST(own - 7 AS DATE)), CAST(d - 7 AS DATE)) AS s FROM i),
c AS (SELECT *, CAST(unnest(generate_series({_FRIDAY.format("CAST(s + 1 AS DATE)")}::TIMESTAMP, own::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS week FROM f),
o AS (SELECT *, date_diff('day', greatest(s, CAST(week - 7 AS DATE)), least(d, week)) AS ov, date_diff('day', s, d) AS len FROM c),
a AS (SELECT coin, week, sum(CASE WHEN own = week THEN 1 ELSE 0 END) AS readings, sum(ov) AS covered_days, sum(v0 * ov / len) AS amount,
        sum(v1 * ov) / sum(CASE WHEN v1 IS NOT NULL THEN ov END) AS level FROM o GROUP BY coin, week),
g AS (SELECT coin, CAST(unnest(generate_series(min(own)::TIMESTAMP, max(own)::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS week FROM i GROUP BY coin)
SELECT coin, week, CAST(coalesce(readings, 0) AS BIGINT) AS readings, CAST(coalesce(covered_days, 0) AS BIGINT) AS covered_days, round(amount + 2e-9, 6) AS n_articles, round(level + 2e-9, 6) AS finbert_exp_hl7,
  round(last_value(level IGNORE NULLS) OVER (PARTITION BY coin ORDER BY week) + 2e-9, 6) AS finbert_filled,
  CASE WHEN coalesce(readings, 0) > 0 THEN 'observed' WHEN covered_days > 0 THEN 'apportioned' ELSE 'uncovered' END AS status
FROM g LEFT JOIN a USING (coin, week)"""

_RAW = _latest("sentiment_weekly", "week", "n_articles", "finbert_exp_hl7")
_COUNTER = _GRID.replace(f"{_RAW},", f"""{_RAW.replace("r AS (", "r0 AS (", 1)},
r1 AS (SELECT coin, d, v1, sum(v0) OVER (PARTITION BY coin ORDER BY d) % {COUNTER_WRAPS} AS total FROM r0),
r AS (SELECT coin, d, v1, CASE WHEN total < lag(total) OVER (PARTITION BY coin ORDER BY d) THEN total ELSE total - lag(total) OVER (PARTITION BY coin ORDER BY d) END AS v0 FROM r1),""")
QUERIES = {"p2_found": p2_found, "p2_valid": p2_valid, "p3_found": p3_found, "p3_prices": p3_prices, "p3_sentiment": p3_sentiment, "p5_found": p5_found, "p6_found": p6_found, "p6_grid": p6_grid, "p6_counter": p6_counter}
SQL = {
    "p2_found": records_sql.FAILED,
    "p2_valid": records_sql.VALID,
    "p5_found": records_sql.MOMENTS,
    "p3_prices": _trailing_sql("panel_prices", "date", "close", "close", {"close": "v0"}),
    "p3_sentiment": _trailing_sql("sentiment_weekly", "week", "n_articles", "finbert_exp_hl7", {"n_articles": "v0", "finbert_exp_hl7": "v1"}),
    "p3_found": _gap_sql("panel_prices", "date", "close") + " UNION ALL " + _gap_sql("sentiment_weekly", "week", "n_articles"),
    "p6_grid": _GRID,
    "p6_counter": f"SELECT coin, week, readings, covered_days, n_articles, status FROM ({_COUNTER})",
    "p6_found": f"SELECT coin, CAST(week AS VARCHAR) AS week_text FROM ({_GRID}) WHERE readings = 0",
}
