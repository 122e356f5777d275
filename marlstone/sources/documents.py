"""Records out of delimited, JSON, feed and HTML text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEWS_SCHEMA = "struct<articles:array<struct<seendate:string,domain:string,url:string,title:string>>>"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def read_csv(spark, path: str, schema: str, optional: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header and a fixed schema; ``optional`` columns (name to type) missing there come out empty."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return with_optional(df, optional or {})


def with_optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """NULLs of the named columns as empty strings; columns that are missing are added empty."""
    for name, kind in columns.items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit("").cast(kind)) if name in df.columns else F.lit("").cast(kind))
    return df


def first_tab(line: Column) -> tuple[Column, Column]:
    """``(date, text)`` of a line, cut at the first tab; date is NULL without one."""
    has = F.contains(line, F.lit("\t"))
    return F.when(has, F.substring_index(line, "\t", 1)), F.when(has, F.substring(line, F.locate("\t", line) + 1, F.length(line))).otherwise(line)


def news_articles(df: DataFrame, json: str) -> DataFrame:
    """One row per article of the JSON documents; the day from the date's first eight digits, others dropped."""
    a = df.withColumn("__a", F.explode(F.from_json(json, NEWS_SCHEMA)["articles"]))
    day = F.try_to_timestamp(F.substring(F.col("__a.seendate"), 1, 8), F.lit("yyyyMMdd")).cast("date")
    out = a.select(*df.columns, day.alias("day"), F.col("__a.domain").alias("source"), F.col("__a.url").alias("url"), F.trim("__a.title").alias("headline"))
    return out.filter(F.col("day").isNotNull() & (F.col("headline") != ""))


def strip_html(html: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"\s+", " ")
    for entity, char in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(text)


def _tag(item: Column, name: str) -> Column:
    raw = F.regexp_extract(item, rf"(?s)<{name}[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1)
    return F.when(raw != "", raw)


def rss_items(df: DataFrame, xml: str, snippet_chars: int = 240) -> DataFrame:
    """``title``, ``link``, ``snippet`` (HTML stripped and cut) and ``published`` of every feed item."""
    d = df.withColumn("__i", F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<item[^>]*>(.*?)</item>"), F.lit(1))))
    i = F.col("__i")
    plain = lambda c: strip_html(strip_html(c))  # noqa: E731  entities may hide markup
    return d.select(*df.columns, plain(_tag(i, "title")).alias("title"), F.trim(_tag(i, "link")).alias("link"), F.substring(plain(_tag(i, "description")), 1, snippet_chars).alias("snippet"), _tag(i, "pubDate").alias("published"))


def meta_description(html: Column) -> Column:
    """Content of the description meta tag, else of og:description; NULL if neither has any.

    The tags are found first (a quoted value may hold ``>``), then each one's attributes are read in
    any order: values in either quotes, which end at the same quote, or bare.
    """
    tags = F.regexp_extract_all(html, F.lit(r"""(?is)<meta\b(?:[^>"']|"[^"]*"|'[^']*')*>"""), F.lit(0))

    def value(tag: Column, names: str) -> Column:
        pattern = rf"""(?is)[\s"'/](?:{names})\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
        return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])

    def by(name: str) -> Column:
        fits = F.filter(tags, lambda t: (F.lower(F.trim(value(t, "name|property"))) == name) & (F.trim(value(t, "content")) != ""))
        return strip_html(value(F.get(fits, F.lit(0)), "content"))

    return F.coalesce(by("description"), by("og:description"))


def enriched(df: DataFrame, snippet: str, html: str, cap: int | None = 50, order: str | None = None, chars: int = 240) -> DataFrame:
    """``df`` with empty snippets taken from their page's description, cut to ``chars``; the first ``cap`` empty ones in ``order``.

    ``cap`` is how many pages a run may fetch (None: all); rows beyond it and pages without a
    description keep their snippet. The rows to enrich are chosen by a top-k, not by a global sort;
    only their ``cap`` keys come to the driver.
    """
    empty = F.coalesce(F.trim(snippet), F.lit("")) == ""
    made = F.substring(meta_description(F.col(html)), 1, chars)
    if cap is None:
        return df.withColumn(snippet, F.when(empty, F.coalesce(made, F.col(snippet))).otherwise(F.col(snippet)))
    if order is None:
        raise ValueError("a cap needs an order")
    first = [r[0] for r in df.filter(empty).select(order).orderBy(order).limit(cap).collect()]
    chosen = empty & F.col(order).isin(first)
    return df.withColumn(snippet, F.when(chosen, F.coalesce(made, F.col(snippet))).otherwise(F.col(snippet)))
