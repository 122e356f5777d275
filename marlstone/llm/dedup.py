"""Records that differ only in how they are written, collapsed into one each and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import durable

#: White space, punctuation, and what shows no sign of its own: format characters and variation selectors.
_IGNORED = r"[\s\p{Z}\p{P}\p{Punct}\p{Cf}\ufe00-\ufe0f]+"

#: A group is hot from this share of all rows on; so there are at most this many hot groups.
HOT_GROUPS = 1000


def composed(text: Column) -> Column:
    """Unicode form NFKC: one way to write composed letters, wide and narrow forms, ligatures.

    By the Unicode library that the engine ships for its collations, in the JVM; text in plain ASCII
    is in that form already and never gets there.
    """
    made = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(F.octet_length(text) > F.char_length(text), made).otherwise(text)


def folded(text: Column) -> Column:
    """Case folded by way of upper case, so that ``ß`` meets ``SS`` and final sigma its capital.

    The replacement between the two keeps the optimizer from reducing lower(upper(x)) to lower(x).
    """
    return F.translate(F.lower(F.replace(F.upper(text), F.lit("ẞ"), F.lit("SS"))), "ς", "σ")


def _bare(text: Column) -> Column:
    return F.regexp_replace(folded(text), _IGNORED, "")


def _sections(text: Column, separator: str) -> Column:
    """Sections in sorted order, each without case, white space and punctuation; empty ones vanish."""
    parts = F.filter(F.transform(F.split(text, separator), _bare), lambda x: x != "")
    return F.array_join(F.array_sort(parts), "|")


def canonical_headline(text: Column) -> Column:
    return _sections(text, r"\|")


def canonical_url(url: Column) -> Column:
    """Base, sorted query fields and fragment."""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"#(?s)(.*)$", 1)
    return F.concat_ws("\u0001", _bare(base), _sections(query, "&"), _bare(fragment))


def keyed(df: DataFrame, key: str, headline: str = "headline", url: str = "url", text: bool = False) -> DataFrame:
    """``__id``, the 128-bit ``__h`` of the canonical record and an independent 64-bit ``__c`` to check it."""
    head, link = canonical_headline(F.col("__head")), canonical_url(F.col("__link"))
    d = df.filter((F.trim(headline) != "") & (F.trim(url) != "")).select(F.col(key).alias("__id"), composed(F.col(headline)).alias("__head"), composed(F.col(url)).alias("__link"))
    d = d.select("__id", head.alias("__head"), link.alias("__link"))
    d = d.filter(F.col("__head") != "")
    whole = F.concat_ws("\u0002", "__head", "__link")
    return d.select("__id", F.unhex(F.md5(whole)).alias("__h"), F.xxhash64(whole).alias("__c"), *([whole.alias("__t")] if text else []))


def _keyed_exactly(df: DataFrame, key: str, headline: str, url: str) -> tuple[DataFrame, DataFrame]:
    """Checkpointed ``(rows, groups)`` in which one hash never stands for two records.

    Groups are counted with map-side combining. A hash whose check values differ is a collision;
    its rows are hashed again together with their check value and text, until none is left.
    """
    rows = durable(keyed(df, key, headline, url))
    counted = lambda r: r.groupBy("__h").agg(F.count("*").alias("__n"), F.min("__id").alias("__keep"), F.min("__c").alias("__lo"), F.max("__c").alias("__hi"))
    groups = durable(counted(rows))
    collided = groups.filter("__lo <> __hi").select("__h")
    if collided.limit(1).count():
        texts = keyed(df, key, headline, url, text=True).join(collided, "__h", "left_semi")
        again = texts.select("__id", F.unhex(F.sha2("__t", 256)).alias("__h"), F.lit(0).cast("long").alias("__c"))
        rows = durable(rows.join(collided, "__h", "left_anti").select("__id", "__h", "__c").unionByName(again))
        groups = durable(counted(rows))
    return rows, groups


def unique_records(df: DataFrame, key: str, headline: str = "headline", url: str = "url") -> DataFrame:
    """One row per distinct record: ``keep_id`` (the smallest key) and ``copies`` (rows, itself included).

    Records are the same if headline and url agree in Unicode form NFKC once white space, letter case,
    punctuation, format characters and the order of headline sections (``|``) and of query fields are
    ignored. Records whose headline
    or url is NULL, empty or nothing but such marks do not count. Repeated keys count as rows.
    """
    return _keyed_exactly(df, key, headline, url)[1].select(F.col("__keep").alias("keep_id"), F.col("__n").alias("copies"))


def copies(df: DataFrame, key: str, headline: str = "headline", url: str = "url") -> DataFrame:
    """``keep_id`` paired with each other key of the same record, ``copy_id`` (see ``unique_records``).

    Rows meet their group by hash. The few groups that hold more than 1/HOT_GROUPS of all rows are
    broadcast (at most HOT_GROUPS of them), so their rows need not gather in one task; the others
    are joined by shuffle.
    """
    rows, groups = _keyed_exactly(df, key, headline, url)
    more = groups.filter("__n > 1").select(F.col("__h").alias("__g"), "__n", "__keep")
    bound = max(1000, rows.count() // HOT_GROUPS)
    hot = F.broadcast(more.filter(F.col("__n") > bound))
    match = F.col("__h") == F.col("__g")
    rest = rows.join(hot, match, "left_anti").join(more.filter(F.col("__n") <= bound), match)
    pairs = rows.join(hot, match).select("__keep", "__id").unionByName(rest.select("__keep", "__id"))
    return pairs.filter("__id <> __keep").select(F.col("__keep").alias("keep_id"), F.col("__id").alias("copy_id"))
