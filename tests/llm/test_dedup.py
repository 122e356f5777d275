"""Formatting duplicates against brute force."""

import re
import unicodedata

from marlstone.llm import dedup
from marlstone.llm.dedup import copies, unique_records
from marlstone.sources.tables import table

PUNCT = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def bare(s):
    return "".join(c for c in s.casefold() if not (c.isspace() or unicodedata.category(c)[0] in "PZ" or c in PUNCT or c in "​﻿"))


def canonical(headline, url):
    head = sorted(x for x in (bare(p) for p in headline.split("|")) if x)
    base, _, rest = url.partition("#")[0].partition("?")
    return tuple(head), bare(base), tuple(sorted(x for x in (bare(p) for p in rest.split("&")) if x)), bare(url.partition("#")[2])


def brute(rows):
    groups = {}
    for k, h, u in rows:
        if h and h.strip(" ") and u and u.strip(" ") and canonical(h, u)[0]:
            groups.setdefault(canonical(h, u), []).append(k)
    return groups


ROWS = [
    (1, "A b | Site", "https://x.example/a-b?p=1&q=2"), (2, "SITE|a  B!", "HTTPS://X.EXAMPLE/A-B/?q=2&p=1"), (2, "Site | A b", "https://x.example/a-b?p=1&q=2"), (3, "A b", "https://x.example/a-b?p=1&q=2"), (4, "A b | Site", "https://x.example/a-b?p=1&q=3"),
    (5, "Größe", "u"), (6, "GRÖSSE", "u"), (7, "ΟΔΟΣ", "u"), (8, "οδός", "u"), (9, "οδος", "u"), (10, None, "u"), (11, "x", None), (12, "", "u"), (13, "x", ""), (14, "!?", "u"), (15, "?!", "u"), (16, "w" * 200_000, "u"), (17, "W " * 200_000, "u"), (18, "x", "u#a"), (19, "x", "u#b"),
]


def check(spark, rows, df=None):
    df = df or spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, headline string, url string, keep_id string, __n int")
    groups = brute(rows)
    assert sorted(map(tuple, unique_records(df, "id").collect())) == sorted((min(v), len(v)) for v in groups.values())
    want = sorted((min(v), k) for v in groups.values() for k in v if k != min(v))
    assert sorted(map(tuple, copies(df, "id").collect())) == want


def test_small(spark):
    check(spark, ROWS)


def test_hot_group(spark):
    rows = ROWS + [(100 + k, "Hot  story" if k % 2 else "hot story.", "https://hot.example/") for k in range(3000)]
    check(spark, rows)


def test_empty(spark):
    check(spark, [])


def test_collisions_are_told_apart(spark, monkeypatch):
    real, asked = dedup.keyed, []

    def weak(df, key, headline="headline", url="url", text=False):
        from pyspark.sql import functions as F

        asked.append(text)
        return real(df, key, headline, url, text).withColumn("__h", F.unhex(F.left(F.hex("__h"), F.lit(1))))

    monkeypatch.setattr(dedup, "keyed", weak)
    check(spark, ROWS)
    assert True in asked  # the colliding rows were hashed again by their text


def test_ways_to_write_the_same_letters(spark):
    same = ["Café rises", "CAFÉ  RISES", "Cafe\u0301 rises", "Ｃａｆé rises", "Ca\u00adfé rises", "Ca\u200dfé ri\u200bses", "Café rises\ufe0f", "“Café” rises…"]
    other = ["Cafe rises", "Café ríses"]
    df = spark.createDataFrame([(k, h, "https://x.example/ﬁle?a=１&b=2" if k % 2 else "https://x.example/file?b=2&a=1") for k, h in enumerate(same + other)], "id long, headline string, url string")
    got = {(r.keep_id, r.copies) for r in unique_records(df, "id").collect()}
    assert got == {(0, len(same)), (len(same), 1), (len(same) + 1, 1)}
    wide = spark.createDataFrame([(1, "A｜B", "u"), (2, "b | a", "u")], "id long, headline string, url string")
    assert [tuple(r) for r in copies(wide, "id").collect()] == [(1, 2)]


def test_given_table(spark, folder):
    df = table(spark, folder, "articles_scraped")
    rows = [(r.article_id, r.headline, r.url) for r in df.select("article_id", "headline", "url").collect()]
    assert all(not re.search(r"^\s+$", r[1] or "x") for r in rows)
    check(spark, rows, df.withColumnRenamed("article_id", "id"))
