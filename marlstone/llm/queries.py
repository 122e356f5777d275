"""Queries of the text-corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.dedup import copies, unique_records
from marlstone.llm.encoding import repair_values
from marlstone.llm.mixing import mix_sources
from marlstone.llm.packing import pack_documents
from marlstone.llm.sentences import sentence_ends, sentences
from marlstone.session import durable
from marlstone.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Damaged values of headline and snippet."""
    return p1_repaired(spark, d).select("article_id", "field")


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The same with the text that can still be known."""
    return repair_values(table(spark, d, "articles_scraped"), "article_id", ["headline", "snippet"]).select("article_id", "field", "restored", "kind")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return copies(table(spark, d, "articles_scraped"), "article_id")


def p4_unique(spark: SparkSession, d: str) -> DataFrame:
    """One row per distinct record with the number of its copies."""
    return unique_records(table(spark, d, "articles_scraped"), "article_id")


#: Limits of ``p7_pack`` beside the capacity: tokens of capacity for one segment, and the share that may bear loss.
SEGMENT_TOKENS, LOSS_SHARE = 128, 0.9


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every text's place in a container, for each capacity, under limits on tokens, segments and loss-bearing tokens at once."""
    return pack_documents(table(spark, d, "documents"), table(spark, d, "pack_capacity"), max_segments=F.floor(F.col("capacity") / SEGMENT_TOKENS), max_loss=LOSS_SHARE, keep_whole=True)


def p7_free(spark: SparkSession, d: str) -> DataFrame:
    """The same with limits beside the capacity that never bind, for as little room as possible."""
    return pack_documents(table(spark, d, "documents"), table(spark, d, "pack_capacity"))


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    """The same under a tighter limit on loss-bearing tokens, 80 % of the capacity, and on segments, eight; texts that fit the capacity stay whole."""
    return pack_documents(table(spark, d, "documents"), table(spark, d, "pack_capacity"), max_segments=8, max_loss=0.8, keep_whole=True)


def _containers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Containers of ``p7_pack`` with their sums and limits, and its rows."""
    rows = durable(p7_pack(spark, d))
    bins = rows.groupBy("capacity_id", "bin").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.sum("loss").alias("l"))
    limits = {"most_n": F.greatest(F.lit(1), F.floor(F.col("capacity_tokens") / SEGMENT_TOKENS)), "most_l": F.greatest(F.lit(1), F.floor(F.col("capacity_tokens") * LOSS_SHARE))}
    return bins.join(table(spark, d, "pack_capacity"), "capacity_id").withColumns(limits), rows


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """By capacity: containers, their fill, the least number each limit alone allows, and the containers in which it binds."""
    made = _containers(spark, d)[0].groupBy("capacity_id", "capacity_tokens", "most_n", "most_l").agg(
        F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.sum("n").alias("segments"), F.sum("l").alias("loss_tokens"),
        F.count_if(F.col("t") >= 0.98 * F.col("capacity_tokens")).alias("full_of_tokens"), F.count_if(F.col("n") == F.col("most_n")).alias("full_of_segments"), F.count_if(F.col("l") >= 0.98 * F.col("most_l")).alias("full_of_loss"),
    )
    least = {"least_by_tokens": F.ceil(F.col("tokens") / F.col("capacity_tokens")), "least_by_segments": F.ceil(F.col("segments") / F.col("most_n")), "least_by_loss": F.ceil(F.col("loss_tokens") / F.col("most_l"))}
    return made.withColumns({**least, "fill": F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))})


def p7_limits_ok(spark: SparkSession, d: str) -> DataFrame:
    """By capacity: documents packed, containers over a limit, and documents whose pieces are not one run from 0 or were cut without need."""
    bins, rows = _containers(spark, d)
    over = bins.groupBy("capacity_id").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("over_tokens"), F.count_if(F.col("n") > F.col("most_n")).alias("over_segments"), F.count_if((F.col("l") > F.col("most_l")) & (F.col("n") > 1)).alias("over_loss"))
    docs = rows.groupBy("capacity_id", "doc_id").agg(F.count("*").alias("n"), F.countDistinct("piece").alias("k"), F.max("piece").alias("last"), F.sum("tokens").alias("t"), F.min(F.least("tokens", F.lit(1))).alias("least"))
    docs = docs.join(table(spark, d, "pack_capacity"), "capacity_id")
    wrong = (F.col("n") != F.col("k")) | (F.col("last") != F.col("n") - 1) | (F.col("least") < 1) | (F.col("n") > 1) & (F.col("t") <= F.col("capacity_tokens"))
    return docs.groupBy("capacity_id").agg(F.count("*").alias("documents"), F.count_if(wrong).alias("wrong_documents")).join(over, "capacity_id")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents chosen for the mixture and how often each is used."""
    return mix_sources(table(spark, d, "documents"), table(spark, d, "source_targets"))[0]


def p8_total(spark: SparkSession, d: str) -> DataFrame:
    """The mixture of an asked size, a million tokens: sources repeat up to their caps, then fall short."""
    return mix_sources(table(spark, d, "documents"), table(spark, d, "source_targets"), total_tokens=1_000_000)[0]


def p8_shares_ok(spark: SparkSession, d: str) -> DataFrame:
    """By listed source of both mixtures: whether repeats keep to the cap, the size comes within a document of its budget and the budget keeps to size and share."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "source_targets")
    parts = []
    for name, total in (("largest", None), ("asked", 1_000_000)):
        chosen, report = mix_sources(docs, targets, total_tokens=total)
        per = chosen.groupBy("source").agg(F.max("tokens").alias("widest"), F.max("repeats").alias("top"), F.sum(F.col("tokens") * F.col("repeats")).alias("got"))
        x = report.join(per, "source", "left")
        got = F.coalesce("got", F.lit(0))
        parts.append(x.select(
            F.lit(name).alias("mixture"), "source", F.coalesce(F.col("top") <= F.col("max_repeats"), F.lit(True)).alias("repeats_ok"),
            ((got == F.col("tokens")) & (F.abs(got - F.col("budget_tokens")) <= F.greatest(F.coalesce("widest", F.lit(0)), F.lit(8192)))).alias("size_ok"),
            (F.col("budget_tokens") <= F.col("size_tokens") * F.col("max_repeats") + 1e-6).alias("budget_ok"),
        ))
    return parts[0].unionByName(parts[1])


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every listed source."""
    return mix_sources(table(spark, d, "documents"), table(spark, d, "source_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """End of every sentence unit of every document."""
    return sentence_ends(table(spark, d, "documents"), "doc_id")


def p9_cover(spark: SparkSession, d: str) -> DataFrame:
    """By document: where its last unit ends, and whether its ends rise without repeats."""
    ends = sentence_ends(table(spark, d, "documents"), "doc_id")
    return ends.groupBy("doc_id").agg(F.max("end_pos").alias("last_end"), (F.countDistinct("end_pos") == F.count("*")).alias("rising"), (F.min("end_pos") > 0).alias("inside"))


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences(table(spark, d, "documents"), "doc_id")


def _bare(x: str) -> str:
    return rf"regexp_replace(replace(lower(replace(upper({x}), 'ẞ', 'SS')), 'ς', 'σ'), '[\s\pZ\pP[:punct:]\x{{200b}}\x{{feff}}]+', '', 'g')"


def _parts(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(list_transform({x}, lambda x: {_bare('x')}), lambda y: y <> '')), '|')"


_CANON = f"""
SELECT article_id, {_parts("string_split(headline, '|')")} AS h, {_bare("regexp_extract(url, '^([^?#]*)', 1)")}
  || '@' || {_parts("string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&')")} || '@' || {_bare("regexp_extract(url, '#(.*)$', 1)")} AS u
FROM articles_scraped WHERE trim(headline) <> '' AND trim(url) <> ''"""

QUERIES = {"p1_found": p1_found, "p1_repaired": p1_repaired, "p4_found": p4_found, "p4_unique": p4_unique, "p7_pack": p7_pack, "p7_limits": p7_limits, "p7_free": p7_free, "p7_report": p7_report, "p7_limits_ok": p7_limits_ok, "p8_mix": p8_mix, "p8_total": p8_total, "p8_report": p8_report, "p8_shares_ok": p8_shares_ok, "p9_cover": p9_cover, "p9_found": p9_found, "p9_sentences": p9_sentences}
SQL = {
    "p7_limits_ok": "SELECT capacity_id, count(*) AS documents, 0 AS wrong_documents, 0 AS over_tokens, 0 AS over_segments, 0 AS over_loss FROM documents CROSS JOIN pack_capacity WHERE text <> '' GROUP BY capacity_id",
    "p8_shares_ok": "SELECT mixture, source, TRUE AS repeats_ok, TRUE AS size_ok, TRUE AS budget_ok FROM (SELECT DISTINCT source FROM source_targets WHERE source IS NOT NULL AND target_share > 0) CROSS JOIN (VALUES ('largest'), ('asked')) m(mixture)",
    "p9_cover": r"SELECT doc_id, length(regexp_replace(text, '[\s\pZ\x{85}\x{1c}-\x{1f}]+$', '')) AS last_end, TRUE AS rising, TRUE AS inside FROM documents WHERE NOT regexp_full_match(text, '[\s\pZ\x{85}\x{1c}-\x{1f}]*')",
    "p4_unique": f"SELECT min(article_id) AS keep_id, count(*) AS copies FROM ({_CANON}) WHERE h <> '' GROUP BY h, u",
    "p4_found": f"SELECT keep_id, article_id AS copy_id FROM (SELECT article_id, min(article_id) OVER (PARTITION BY h, u) AS keep_id FROM ({_CANON}) WHERE h <> '') WHERE keep_id <> article_id",
}
