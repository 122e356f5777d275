"""Queries of sources, joins, aggregates and text operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.calendar import month_end, spine, week_end
from marlstone.functions.text import LEXICON, decay_weight, joined_text, joined_text_once, lexicon_compound, weighted_mean, with_lexicon_scores
from marlstone.operators.joins import asof_forward, positional_join, score_with_cache, trailing_join
from marlstone.operators.windows import along, keep_first, sorted_codes, top_k
from marlstone.plans.prepare import settled
from marlstone.plans.series import FRI, PX, R6, RET, SENT, prices, r6, returns, sentiment
from marlstone.session import durable
from marlstone.sources.documents import first_tab, news_articles, meta_description, rss_items, with_optional
from marlstone.sources.tables import table

# ---- sources -------------------------------------------------------------------------------------------------


def s1_csv(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as CSV lines and read back under a fixed schema."""
    c = table(spark, d, "customer").select(F.to_csv(F.struct("c_custkey", "c_name", "c_nationkey", "c_acctbal")).alias("line"))
    return c.select(F.from_csv("line", "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE").alias("r")).select("r.*")


def s2_optional(spark: SparkSession, d: str) -> DataFrame:
    """Missing and NULL text columns as empty strings."""
    a = with_optional(table(spark, d, "articles_scraped").select("article_id", "headline"), {"headline": "string", "summary": "string"})
    return a.select("article_id", "headline", "summary")


def s3_first_tab(spark: SparkSession, d: str) -> DataFrame:
    """Lines cut at the first tab, blank ones skipped."""
    a = table(spark, d, "articles_raw").filter(F.trim("line") != "")
    date, text = first_tab(F.col("line"))
    return a.select("line_id", date.alias("date"), text.alias("text"))


def s9_json(spark: SparkSession, d: str) -> DataFrame:
    """Articles out of JSON documents with an articles array."""
    a = table(spark, d, "documents").select("doc_id", F.struct(F.array(F.struct(F.date_format("published", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"), F.col("source").alias("domain"), F.lit("u").alias("url"), F.substring("text", 1, 40).alias("title"))).alias("articles")).alias("s"))
    return news_articles(a.select("doc_id", F.to_json("s").alias("json")), "json").select("doc_id", "day", "source", "headline")


def s9_articles(spark: SparkSession, d: str) -> DataFrame:
    """The same with whole texts as titles, so that line breaks, quotes and escapes pass the parser."""
    a = table(spark, d, "documents").select("doc_id", F.struct(F.array(F.struct(F.date_format("published", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"), F.col("source").alias("domain"), F.lit("u").alias("url"), F.col("text").alias("title"))).alias("articles")).alias("s"))
    return news_articles(a.select("doc_id", F.to_json("s").alias("json")), "json").select("doc_id", "day", "source", "headline")


def s9_props(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the JSON column of events."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.size(F.json_object_keys("props")).alias("fields"))


def s10_rss(spark: SparkSession, d: str) -> DataFrame:
    """Feed items out of XML."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    name = F.col("p_name")
    xml = F.concat(F.lit("<rss><channel><item><title>"), esc(name), F.lit("</title><link> http://x.example/"), F.col("p_partkey").cast("string"), F.lit(" </link><description>&lt;p&gt;"), esc(F.col("p_type")), F.lit("&lt;/p&gt;</description><pubDate>2024</pubDate></item></channel></rss>"))
    return rss_items(table(spark, d, "part").select("p_partkey", xml.alias("xml")), "xml").select("p_partkey", "title", "link", "snippet", "published")


def s11_meta(spark: SparkSession, d: str) -> DataFrame:
    """Description out of a page's head, the second choice where the first is missing."""
    name = F.when(F.col("p_size") > 25, F.lit('property="og:description"')).otherwise(F.lit('name="description"'))
    html = F.concat(F.lit("<html><head><meta "), name, F.lit(' content="'), F.col("p_name"), F.lit('"></head></html>'))
    return table(spark, d, "part").select("p_partkey", meta_description(html).alias("description"))


# ---- joins ---------------------------------------------------------------------------------------------------


def j1_month(spark: SparkSession, d: str) -> DataFrame:
    """Monthly levels and sentiment, inner join on coin and month end."""
    a = prices(spark, d).groupBy("coin", month_end(F.col("d")).alias("month_end")).agg(F.max_by("level", "d").alias("level"))
    b = sentiment(spark, d).groupBy("coin", month_end(F.col("week")).alias("month_end")).agg(F.avg("s").alias("s"), F.sum("n").alias("n"))
    return a.join(b, ["coin", "month_end"]).select("coin", "month_end", "n", *r6(level=F.col("level"), s=F.col("s")))


def j3_cache(spark: SparkSession, d: str) -> DataFrame:
    """Scores from a cache of the English sources; the other documents are scored."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    english = table(spark, d, "sources").filter("lang = 'en'").select("source")
    cache = docs.join(english, "source", "left_semi").select("doc_id", lexicon_compound(F.col("text")).alias("score"))
    x = score_with_cache(docs, cache, ["doc_id"], "score", lambda m: lexicon_compound(F.col("text")))
    return x.select("doc_id", "cached", *r6(score=F.col("score")))


def j6_outer(spark: SparkSession, d: str) -> DataFrame:
    """Weekly rows of prices and of sentiment, full outer join."""
    a = prices(spark, d).groupBy("coin", week_end(F.col("d")).alias("week")).agg(F.count("*").alias("days"))
    b = sentiment(spark, d).groupBy("coin", week_end(F.col("week")).alias("week")).agg(F.sum("n").alias("articles"))
    return a.join(b, ["coin", "week"], "full_outer").select("coin", "week", "days", "articles")


def j8_asof(spark: SparkSession, d: str) -> DataFrame:
    """First trading day at or after each sentiment week."""
    x = asof_forward(sentiment(spark, d).select("coin", "week"), prices(spark, d), ["coin"], "week", "d", "trade_day")
    return x.select("coin", "week", "trade_day")


def j9_trailing(spark: SparkSession, d: str) -> DataFrame:
    """Mean sentiment and news of the 28 days up to each trading day."""
    x = trailing_join(prices(spark, d).select("coin", "d"), sentiment(spark, d), ["coin"], "d", "week", 28, [F.avg("s").alias("s"), F.avg("n").alias("n"), F.count("*").alias("weeks")])
    return x.select("coin", "d", "weeks", *r6(s=F.col("s"), n=F.col("n")))


def j10_positional(spark: SparkSession, d: str) -> DataFrame:
    """Returns at positions -3..3 around each coin's worst day."""
    x = returns(spark, d).withColumn("rn", F.row_number().over(along(["coin"], "d")))
    worst = x.filter("r is not null").groupBy("coin").agg(F.min(F.struct("r", "rn")).alias("w")).select("coin", F.col("w.rn").alias("t0"))
    return positional_join(worst, x.select("coin", "rn", "d", "r"), ["coin"], "t0", "rn", (-3, 3)).select("coin", "t0", "rel", "d", *r6(r=F.col("r")))


# ---- aggregates, sets, text --------------------------------------------------------------------------------------


def _scored(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").filter(F.col("published").isNotNull())
    return with_lexicon_scores(x, "text").select("doc_id", "coin", "published", F.col("compound").alias("v"), F.col("polarity").alias("p"))


def _composite(x: DataFrame, period: str, keys: list[str]) -> DataFrame:
    w = decay_weight(F.datediff(F.col(period), F.col("published")), 7.0)
    return x.groupBy(*keys, period).agg(F.count("*").alias("n_articles"), settled(F.avg("v")).alias("linear"), settled(weighted_mean(F.col("v"), w)).alias("exp_hl7"), settled(F.avg("p")).alias("polarity"))


def a1_monthly(spark: SparkSession, d: str) -> DataFrame:
    """Monthly composites: count, mean, mean with a half-life of seven days to the month's end."""
    return _composite(_scored(spark, d).withColumn("month_end", month_end(F.col("published"))), "month_end", [])


def a2_weekly(spark: SparkSession, d: str) -> DataFrame:
    """Weekly composites."""
    return _composite(_scored(spark, d).withColumn("week", week_end(F.col("published"))), "week", [])


def a3_coin_weekly(spark: SparkSession, d: str) -> DataFrame:
    """Weekly composites by coin on a spine of its weeks: one without documents has a count of 0 and NULL means."""
    made = durable(_composite(_scored(spark, d).filter("coin is not null").withColumn("week", week_end(F.col("published"))), "week", ["coin"]))
    return spine(made, "week", ["coin"], "7 days", "week").join(made, ["coin", "week"], "left").fillna({"n_articles": 0})


def a4_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles_scraped").groupBy("source").count().select("source", F.col("count").alias("n"))


def a5_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles, mean, deviations, median, range and distinct days by coin."""
    x = prices(spark, d)
    q = lambda p: settled(F.percentile("level", F.lit(p)))
    return x.groupBy("coin").agg(
        q(0.1).alias("q10"), q(0.9).alias("q90"), settled(F.median("level")).alias("med"), settled(F.avg("level")).alias("mean"), settled(F.stddev_samp("level")).alias("sd1"), settled(F.stddev_pop("level")).alias("sd0"),
        settled(F.min("level")).alias("lo"), settled(F.max("level")).alias("hi"), F.countDistinct("d").alias("days"),
    )


def a8_nulls(spark: SparkSession, d: str) -> DataFrame:
    """NULLs by column of the raw panel."""
    x = table(spark, d, "panel_prices")
    return x.agg(F.count_if(F.col("close").isNull()).alias("close_nulls"), F.count_if(F.col("loaded_at").isNull()).alias("loaded_nulls"), F.countDistinct("coin").alias("coins"), F.count("*").alias("n"))


def a10_corr(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of two sentiment columns, regression line, and the share of positive scores."""
    x = table(spark, d, "sentiment_weekly").filter("finbert_linear is not null and vader_linear is not null")
    a, b = "finbert_linear", "vader_linear"
    return x.groupBy("coin").agg(settled(F.corr(a, b)).alias("r"), settled(F.regr_slope(a, b)).alias("slope"), settled(F.regr_intercept(a, b)).alias("intercept"), settled(F.avg((F.col(a) > 0).cast("double"))).alias("positive"))


def a14_density(spark: SparkSession, d: str) -> DataFrame:
    """Months by whether they hold fewer than ten documents."""
    m = table(spark, d, "documents").filter("published is not null").groupBy(month_end(F.col("published")).alias("m")).agg(F.count("*").alias("n"))
    return m.groupBy((F.col("n") < 10).alias("thin")).agg(F.count("*").alias("months"), F.min("n").alias("least"), settled(F.median("n")).alias("med"))


def o5_cap(spark: SparkSession, d: str) -> DataFrame:
    """At most three documents of a source and month, the longest first."""
    x = table(spark, d, "documents").filter("published is not null and source is not null").select("doc_id", "source", "n_chars", month_end(F.col("published")).alias("month_end"))
    return top_k(x, ["source", "month_end"], [F.desc("n_chars"), F.asc("doc_id")], 3).select("source", "month_end", "doc_id")


def o6_first(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each source and headline."""
    x = table(spark, d, "articles_scraped").select("article_id", "source", "headline", "url")
    return keep_first(x, ["source", "headline"], [F.col("article_id")])


def u1_union(spark: SparkSession, d: str) -> DataFrame:
    """Texts of all three corpora with their lengths."""
    t = lambda n, k, c: table(spark, d, n).select(F.lit(n).alias("tbl"), F.col(k).alias("id"), F.length(c).alias("chars"))
    return t("articles", "line_id", "text").unionByName(t("articles_scraped", "article_id", "headline")).unionByName(t("documents", "doc_id", "text"))


def x4_texts(spark: SparkSession, d: str) -> DataFrame:
    """The two text projections for scoring."""
    x = table(spark, d, "articles_scraped")
    return x.select("article_id", F.length(joined_text(F.col("headline"), F.col("snippet"))).alias("plain"), F.length(joined_text_once(F.col("headline"), F.col("snippet"), 240)).alias("once"))


def x1_scores(spark: SparkSession, d: str) -> DataFrame:
    """Lexicon score and polarity of every document."""
    return with_lexicon_scores(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", *r6(compound=F.col("compound"), polarity=F.col("polarity")))


def q12_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of a category in sorted order and indicator of all but the first level, from the table of its levels."""
    x = prices(spark, d)
    return x.join(sorted_codes(x, "coin"), "coin").groupBy("coin", "code").agg(F.count("*").alias("n"), F.sum((F.col("code") > 0).cast("int")).alias("indicated"))


def f14_zscore(spark: SparkSession, d: str) -> DataFrame:
    """Score in standard deviations within the coin, 0 where there is no spread."""
    whole = Window.partitionBy("coin")
    sd = F.stddev_pop("level").over(whole)
    return prices(spark, d).select("coin", "d", *r6(z=F.when(sd > 0, (F.col("level") - F.avg("level").over(whole)) / sd).otherwise(0.0)))


def f1_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Scalar functions: logs, clips, typical price, date distance, decay, keys, encodings."""
    c = F.col
    x = table(spark, d, "lineitem")
    return x.select(
        "l_orderkey", "l_linenumber", F.left(F.md5(F.concat_ws("|", c("l_orderkey").cast("string"), c("l_linenumber").cast("string"))), F.lit(16)).alias("key"), F.url_encode(F.concat(c("l_returnflag"), F.lit(" & "), c("l_linestatus"))).alias("enc"),
        F.date_format("l_shipdate", "yyyyMMdd").alias("ymd"), F.datediff(F.last_day("l_shipdate"), c("l_shipdate")).alias("left_days"),
        *r6(ln=F.ln("l_extendedprice"), l1p=F.log1p("l_quantity"), clip=F.least(F.greatest(c("l_discount"), F.lit(0.02)), F.lit(0.08)), typical=(c("l_extendedprice") + c("l_quantity") + c("l_tax")) / 3, sig=1 / (1 + F.exp(-c("l_tax"))), half=F.pow(F.lit(0.5), c("l_quantity") / 26)),
    )


QUERIES = {f.__name__: f for f in (
    s1_csv, s2_optional, s3_first_tab, s9_json, s9_articles, s9_props, s10_rss, s11_meta, j1_month, j3_cache, j6_outer, j8_asof, j9_trailing, j10_positional,
    a1_monthly, a2_weekly, a3_coin_weekly, a4_counts, a5_quantiles, a8_nulls, a10_corr, a14_density, o5_cap, o6_first, u1_union, x4_texts, x1_scores, q12_codes, f14_zscore, f1_scalars,
)}
_WORDS = "|".join(sorted(LEXICON))
_VALUES = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in sorted(LEXICON.items())) + "}"
_SCORE = rf"""sc0 AS (SELECT *, list_transform(regexp_extract_all(lower(text), '\b({_WORDS})\b', 1), lambda w: {_VALUES}[w]) AS hits FROM documents),
sc AS (SELECT *, coalesce(list_sum(hits), 0) AS s, CASE WHEN len(hits) > 0 THEN list_sum(hits) / len(hits) / 3.0 ELSE 0.0 END AS p FROM sc0)"""
_V = "(s / sqrt(s * s + 15))"


def _comp(period: str, name: str, keys: str = "", where: str = "") -> str:
    w = f"exp(-ln(2) / 7 * greatest(date_diff('day', published, {period}), 0))"
    return f"WITH {_SCORE} SELECT {keys}{period} AS {name}, count(*) AS n_articles, {R6(f'avg({_V})')} AS linear, {R6(f'sum({_V} * {w}) / sum({w})')} AS exp_hl7, {R6('avg(p)')} AS polarity FROM sc WHERE published IS NOT NULL {where} GROUP BY {keys}{period}"


_STRIP = lambda x: rf"regexp_replace({x}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"
_TRIM = _STRIP("coalesce(headline, '')")
_BOTH = _STRIP("coalesce(headline, '') || '. ' || coalesce(snippet, '')")
SQL = {
    "s1_csv": "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer",
    "s2_optional": "SELECT article_id, coalesce(headline, '') AS headline, '' AS summary FROM articles_scraped",
    "s3_first_tab": r"SELECT line_id, CASE WHEN contains(line, chr(9)) THEN split_part(line, chr(9), 1) END AS date, CASE WHEN contains(line, chr(9)) THEN substr(line, strpos(line, chr(9)) + 1) ELSE line END AS text FROM articles_raw WHERE trim(line) <> ''",
    "s9_json": "SELECT doc_id, published AS day, source, trim(left(text, 40)) AS headline FROM documents WHERE published IS NOT NULL AND trim(left(text, 40)) <> ''",
    "s9_articles": "SELECT doc_id, published AS day, source, trim(text) AS headline FROM documents WHERE published IS NOT NULL AND trim(text) <> ''",
    "s9_props": "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(len(json_keys(props)) AS INTEGER) AS fields FROM events",
    "s10_rss": "SELECT p_partkey, p_name AS title, 'http://x.example/' || p_partkey AS link, p_type AS snippet, '2024' AS published FROM part",
    "s11_meta": "SELECT p_partkey, p_name AS description FROM part",
    "j1_month": f"WITH {PX}, {SENT}, a AS (SELECT coin, last_day(d) AS m, arg_max(level, d) AS level FROM px GROUP BY ALL), b AS (SELECT coin, last_day(week) AS m, avg(s) AS s, sum(n) AS n FROM sen GROUP BY ALL) SELECT coin, m AS month_end, n, {R6('level')} AS level, {R6('s')} AS s FROM a JOIN b USING (coin, m)",
    "j3_cache": f"WITH {_SCORE} SELECT doc_id, coalesce(source IN (SELECT source FROM sources WHERE lang = 'en'), FALSE) AS cached, {R6(_V)} AS score FROM sc",
    "j6_outer": f"WITH {PX}, {SENT}, a AS (SELECT coin, {FRI('d')} AS week, count(*) AS days FROM px GROUP BY ALL), b AS (SELECT coin, {FRI('week')} AS week, sum(n) AS articles FROM sen GROUP BY ALL) SELECT coin, week, days, articles FROM a FULL JOIN b USING (coin, week)",
    "j8_asof": f"WITH {PX}, {SENT} SELECT sen.coin, sen.week, px.d AS trade_day FROM sen ASOF LEFT JOIN px ON sen.coin = px.coin AND sen.week <= px.d",
    "j9_trailing": f"WITH {PX}, {SENT} SELECT px.coin, px.d, nullif(count(sen.n), 0) AS weeks, {R6('avg(sen.s)')} AS s, {R6('avg(sen.n)')} AS n FROM px LEFT JOIN sen ON sen.coin = px.coin AND sen.week > px.d - 28 AND sen.week <= px.d GROUP BY ALL",
    "j10_positional": f"WITH {RET}, q AS (SELECT *, row_number() OVER (PARTITION BY coin ORDER BY d) AS rn FROM ret), w AS (SELECT coin, arg_min(rn, (r, rn)) AS t0 FROM q WHERE r IS NOT NULL GROUP BY coin) SELECT coin, CAST(t0 AS INTEGER) AS t0, CAST(rn - t0 AS INTEGER) AS rel, d, {R6('r')} AS r FROM q JOIN w USING (coin) WHERE rn BETWEEN t0 - 3 AND t0 + 3",
    "a1_monthly": _comp("last_day(published)", "month_end"),
    "a2_weekly": _comp(FRI("published"), "week"),
    "a3_coin_weekly": f"WITH c AS ({_comp(FRI('published'), 'week', 'coin, ', 'AND coin IS NOT NULL')}), s AS (SELECT coin, CAST(unnest(generate_series(min(week)::TIMESTAMP, max(week)::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS week FROM c GROUP BY coin) SELECT coin, week, coalesce(n_articles, 0) AS n_articles, linear, exp_hl7, polarity FROM s LEFT JOIN c USING (coin, week)",
    "a4_counts": "SELECT source, count(*) AS n FROM articles_scraped GROUP BY source",
    "a5_quantiles": f"WITH {PX} SELECT coin, {R6('quantile_cont(level, 0.1)')} AS q10, {R6('quantile_cont(level, 0.9)')} AS q90, {R6('median(level)')} AS med, {R6('avg(level)')} AS mean, {R6('stddev_samp(level)')} AS sd1, {R6('stddev_pop(level)')} AS sd0, {R6('min(level)')} AS lo, {R6('max(level)')} AS hi, count(DISTINCT d) AS days FROM px GROUP BY coin",
    "a8_nulls": "SELECT count(*) FILTER (WHERE close IS NULL) AS close_nulls, count(*) FILTER (WHERE loaded_at IS NULL) AS loaded_nulls, count(DISTINCT coin) AS coins, count(*) AS n FROM panel_prices",
    "a10_corr": f"SELECT coin, {R6('corr(finbert_linear, vader_linear)')} AS r, {R6('regr_slope(finbert_linear, vader_linear)')} AS slope, {R6('regr_intercept(finbert_linear, vader_linear)')} AS intercept, {R6('avg(CAST(finbert_linear > 0 AS DOUBLE))')} AS positive FROM sentiment_weekly WHERE finbert_linear IS NOT NULL AND vader_linear IS NOT NULL GROUP BY coin",
    "a14_density": f"SELECT n < 10 AS thin, count(*) AS months, min(n) AS least, {R6('median(n)')} AS med FROM (SELECT last_day(published) AS m, count(*) AS n FROM documents WHERE published IS NOT NULL GROUP BY ALL) GROUP BY ALL",
    "o5_cap": "SELECT source, last_day(published) AS month_end, doc_id FROM documents WHERE published IS NOT NULL AND source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, last_day(published) ORDER BY n_chars DESC, doc_id) <= 3",
    "o6_first": "SELECT source, headline, article_id, url FROM articles_scraped QUALIFY row_number() OVER (PARTITION BY source, headline ORDER BY article_id) = 1",
    "u1_union": "SELECT 'articles' AS tbl, line_id AS id, CAST(length(text) AS INTEGER) AS chars FROM articles UNION ALL SELECT 'articles_scraped', article_id, CAST(length(headline) AS INTEGER) FROM articles_scraped UNION ALL SELECT 'documents', doc_id, CAST(length(text) AS INTEGER) FROM documents",
    "x4_texts": f"SELECT article_id, CAST(length({_BOTH}) AS INTEGER) AS plain, CAST(length(left(CASE WHEN {_TRIM} = {_STRIP("coalesce(snippet, '')")} THEN {_TRIM} ELSE {_BOTH} END, 240)) AS INTEGER) AS once FROM articles_scraped",
    "x1_scores": f"WITH {_SCORE} SELECT doc_id, {R6(_V)} AS compound, {R6('p')} AS polarity FROM sc",
    "q12_codes": f"WITH {PX}, l AS (SELECT coin, dense_rank() OVER (ORDER BY coin) - 1 AS code FROM px) SELECT coin, CAST(code AS INTEGER) AS code, count(*) AS n, CAST(sum(CAST(code > 0 AS INTEGER)) AS BIGINT) AS indicated FROM l GROUP BY ALL",
    "f14_zscore": f"WITH {PX} SELECT coin, d, {R6('CASE WHEN stddev_pop(level) OVER w > 0 THEN (level - avg(level) OVER w) / stddev_pop(level) OVER w ELSE 0 END')} AS z FROM px WINDOW w AS (PARTITION BY coin)",
    "f1_scalars": f"SELECT l_orderkey, l_linenumber, left(md5(l_orderkey || '|' || l_linenumber), 16) AS key, replace(url_encode(l_returnflag || ' & ' || l_linestatus), '%20', '+') AS enc, strftime(l_shipdate, '%Y%m%d') AS ymd, CAST(date_diff('day', CAST(l_shipdate AS DATE), last_day(l_shipdate)) AS INTEGER) AS left_days, {R6('ln(l_extendedprice)')} AS ln, {R6('ln(1 + l_quantity)')} AS l1p, {R6('least(greatest(l_discount, 0.02), 0.08)')} AS clip, {R6('(l_extendedprice + l_quantity + l_tax) / 3')} AS typical, {R6('1 / (1 + exp(-l_tax))')} AS sig, {R6('pow(0.5, l_quantity / 26)')} AS half FROM lineitem",
}
