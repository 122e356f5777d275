"""Joins, windows, sources, streaming and bootstrap beside plain Python."""

import json
import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from marlstone.functions.text import joined_text_once, lexicon_compound, lexicon_polarity
from marlstone.operators.events import bootstrap_means
from marlstone.operators.joins import asof_forward, positional_join, score_with_cache, trailing_join
from marlstone.operators.windows import along, average_rank, gap_clusters, keep_first, rolling
from marlstone.sources.archive import JsonArchive, first_available, read_through, request_key
from marlstone.sources.documents import news_articles, meta_description, read_csv, rss_items
from marlstone.streaming.weekly import run_available, weekly_stream


def day(k):
    return date(2021, 1, 1) + timedelta(k)


def test_asof_and_trailing(spark):
    rng = random.Random(1)
    left = [(rng.choice("ab"), day(k)) for k in range(0, 60, 3)] + [("c", day(1)), (None, day(1)), ("a", None)]
    right = [(rng.choice("ab"), day(rng.randrange(60)), float(k)) for k in range(40)]
    l, r = spark.createDataFrame(left, "k string, t date"), spark.createDataFrame(right, "k string, d date, v double")  # noqa: E741
    got = asof_forward(l, r, ["k"], "t", "d").collect()
    assert len(got) == len(left)
    for x in got:
        after = [d for k, d, _ in right if k == x.k and x.t and d >= x.t]
        assert x.matched == (min(after) if after and x.k else None)
    got = trailing_join(l.filter("k is not null and t is not null"), r, ["k"], "t", "d", 28, [F.sum("v").alias("s")]).collect()
    for x in got:
        vs = [v for k, d, v in right if k == x.k and x.t - timedelta(28) < d <= x.t]
        assert x.s == (sum(vs) if vs else None)
    assert asof_forward(l.limit(0), r, ["k"], "t", "d").count() == 0


def test_positions_and_cache(spark):
    rows = spark.createDataFrame([("a", k, k * 1.0) for k in range(10)], "g string, n int, v double")
    got = positional_join(spark.createDataFrame([("a", 1), ("a", 5)], "g string, at int"), rows, ["g"], "at", "n", (-2, 1)).collect()
    assert sorted((x["at"], x.rel, x.v) for x in got) == [(1, -1, 0.0), (1, 0, 1.0), (1, 1, 2.0), (5, -2, 3.0), (5, -1, 4.0), (5, 0, 5.0), (5, 1, 6.0)]
    df = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "id int, t string")
    cache = spark.createDataFrame([(1, 9.0), (7, 1.0)], "id int, score double")
    assert sorted((x.t, x.score, x.cached) for x in score_with_cache(df, cache, ["id"], "score", lambda m: F.lit(0.5)).collect()) == [("x", 9.0, True), ("y", 0.5, False), ("z", 0.5, False)]


def test_windows(spark):
    xs = [1.0, None, 3.0, 4.0, 5.0, 5.0]
    df = spark.createDataFrame([("a", day(k), v) for k, v in enumerate(xs)], "k string, d date, v double")
    w = along(["k"], "d")
    assert [r.s for r in df.select("d", rolling("sum", F.col("v"), w, 3).alias("s")).orderBy("d").collect()] == [None, None, None, None, 12.0, 14.0]
    assert [r.s for r in df.select("d", rolling("sum", F.col("v"), w, 3, 2).alias("s")).orderBy("d").collect()] == [None, None, 4.0, 7.0, 12.0, 14.0]
    assert sorted(r.r for r in df.filter("v is not null").select(average_rank(F.col("v"), ["k"]).alias("r")).collect()) == [1, 2, 3, 4.5, 4.5]
    c = gap_clusters(spark.createDataFrame([("a", day(k)) for k in (0, 30, 61, 62)], "k string, d date"), ["k"], "d", 30).orderBy("d").collect()
    assert [r.cluster_id for r in c] == [1, 1, 2, 2]
    first = keep_first(spark.createDataFrame([(1, "b", 2), (1, "a", 1), (None, "c", 3)], "k int, v string, o int"), ["k"], [F.col("o")]).collect()
    assert sorted((r.k or 0, r.v) for r in first) == [(0, "c"), (1, "a")]


def test_sources(spark, tmp_path):
    docs = spark.createDataFrame([(json.dumps({"articles": [{"seendate": "20210304T000000Z", "domain": "d", "url": "u", "title": " T "}, {"seendate": "bad", "title": "x"}]}),), ("{}",), ("nonsense",), (None,)], "j string")
    assert [(r.day, r.headline) for r in news_articles(docs, "j").collect()] == [(date(2021, 3, 4), "T")]
    xml = "<rss><item><title>A &amp; b</title><link> http://l </link><description><![CDATA[<p>Text</p> more]]></description><pubDate>Mon</pubDate></item><item><title>Only</title></item></rss>"
    assert [(r.title, r.link, r.snippet) for r in rss_items(spark.createDataFrame([(xml,), (None,)], "x string"), "x").collect()] == [("A & b", "http://l", "Text more"), ("Only", None, None)]
    html = "<meta property='og:description' content='og'><meta name=\"description\" content=\"plain\">"
    assert [r.m for r in spark.createDataFrame([(html,), ("<p>",), (None,)], "h string").select(meta_description(F.col("h")).alias("m")).collect()] == ["plain", None, None]
    (tmp_path / "a.csv").write_text("id,name\n1,\n2,x\n")
    assert [(r.id, r.name, r.extra) for r in read_csv(spark, str(tmp_path / "a.csv"), "id int, name string", {"name": "string", "extra": "string"}).collect()] == [(1, "", ""), (2, "x", "")]
    made = []
    for _ in range(2):
        t = read_through(spark, str(tmp_path / "t"), lambda: made.append(1) or spark.range(3))
        assert t.count() == 3
    assert made == [1] and first_available(spark, str(tmp_path / "no"), str(tmp_path / "t")).count() == 3
    (tmp_path / (request_key("q", "a", "b") + ".json")).write_text('{"articles": []}')
    spark.dataSource.register(JsonArchive)
    got = spark.read.format("json_archive").option("requests", json.dumps([["q", "a", "b"], ["q", "b", "c"]])).load(str(tmp_path)).collect()
    assert [(r.query, r.first) for r in got] == [("q", "a")]


def test_text(spark):
    df = spark.createDataFrame([("Prices jumped, nobody lost.", "x"), ("nothing", "nothing "), (None, None)], "h string, s string")
    got = df.select(lexicon_compound(F.col("h")).alias("c"), lexicon_polarity(F.col("h")).alias("p"), joined_text_once(F.col("h"), F.col("s")).alias("t")).collect()
    s = 2.5 - 2.2
    assert abs(got[0].c - s / (s * s + 15) ** 0.5) < 1e-12 and abs(got[0].p - s / 2 / 3) < 1e-12 and got[0].t == "Prices jumped, nobody lost.. x"
    assert (got[1].c, got[1].p, got[1].t) == (0.0, 0.0, "nothing") and got[2].c is None and got[2].t == ""


def test_bootstrap_covers_the_mean(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([("a", k, rng.gauss(1, 1)) for k in range(200)], "g string, k int, car double")
    r = bootstrap_means(df, ["g"], replicates=300).collect()[0]
    assert r.lo < r["mean"] < r.hi and 0.15 < r.hi - r.lo < 0.45


def test_stream_equals_batch(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet")
    batch = {(r.week, r.event_type): r.n for r in weekly_stream(events, "ts", "event_type", "value").collect()}
    stream = run_available(spark, f"{folder}/events.parquet*", events.schema, str(tmp_path), "ts", "event_type", "value")
    assert {(r.week, r.event_type): r.n for r in stream.collect()} == batch and all(w.weekday() == 4 for w, _ in batch)


def test_recovery_weights(spark):
    """Zero on days without loss, in (0, 1] on days of loss, and the rows to regain half of it over ten."""
    from marlstone.operators.labels import recovery_weights

    rng = random.Random(9)
    levels = [100.0]
    for _ in range(300):
        levels.append(levels[-1] * (1 + rng.gauss(0, 0.03)))
    df = spark.createDataFrame([("a", day(k), v) for k, v in enumerate(levels)], "coin string, d date, level double")
    got = [r.w for r in recovery_weights(df).orderBy("d").collect()]
    for t, w in enumerate(got):
        if t == 0 or levels[t] >= levels[t - 1]:
            assert w == 0
            continue
        target = levels[t] + 0.5 * (levels[t - 1] - levels[t])
        tau = next((s for s in range(1, 11) if t + s < len(levels) and levels[t + s] >= target), 10)
        assert w == tau / 10


def test_asof_in_buckets_equals_asof(spark):
    from marlstone.operators.joins import asof_forward_split

    rng = random.Random(2)
    left = [(rng.choice("ab"), day(rng.randrange(900))) for _ in range(60)] + [("c", day(1)), ("a", None)]
    right = [(rng.choice("ab"), day(rng.randrange(800))) for _ in range(12)] + [("a", None)]
    l, r = spark.createDataFrame(left, "k string, t date"), spark.createDataFrame(right, "k string, d date")  # noqa: E741
    key = lambda x: (x.k, x.t or date.min, x.matched or date.min)
    for days in (1, 16, 64, 5000):
        assert sorted(map(key, asof_forward_split(l, r, ["k"], "t", "d", bucket_days=days).collect())) == sorted(map(key, asof_forward(l, r, ["k"], "t", "d").collect()))
    got = asof_forward_split(l.select("t").distinct(), r, [], "t", "d").collect()
    days = sorted(d for _, d in right if d)
    assert all(x.matched == next((d for d in days if x.t and d >= x.t), None) for x in got)
    assert asof_forward_split(l.limit(0), r, [], "t", "d").count() == 0 and asof_forward_split(l, r.limit(0), ["k"], "t", "d").filter("matched is not null").count() == 0


def test_codes_and_ranks_spread_over_ranges(spark):
    from marlstone.operators import kernels as K
    from marlstone.operators.metrics import metrics, roc_points
    from marlstone.operators.windows import sorted_codes
    import numpy as np

    words = ["b", "a", "a", None, "zz", "c"] + [f"w{k:03d}" for k in range(200)]
    got = {r.w: r.code for r in sorted_codes(spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()}
    assert got == {w: k for k, w in enumerate([None, *sorted({w for w in words if w})])}
    assert sorted_codes(spark.createDataFrame([], "w string"), "w").count() == 0
    rng = np.random.default_rng(1)
    p, y = np.round(rng.random(3000), 3), (rng.random(3000) < 0.3).astype(int)
    keys = [None if k % 3 else "g" for k in range(3000)]
    df = spark.createDataFrame([(k, float(a), int(b)) for k, a, b in zip(keys, p, y)], "k string, p double, y int")
    for r in metrics(df, ["k"]).collect():
        mine = np.array([x == r.k for x in keys])
        assert abs(r.auc - K.auc(y[mine].astype(float), p[mine])) < 1e-12 and r.n == mine.sum()
    top = roc_points(df, ["k"]).groupBy("k").agg(F.max("tpr").alias("t"), F.max("fpr").alias("f")).collect()
    assert len(top) == 2 and all(r.t == 1 and r.f == 1 for r in top)
    assert metrics(df.limit(0), ["k"]).count() == 0


def test_description_in_any_order_and_quote(spark):
    from marlstone.sources.documents import enriched

    pages = [
        ('<meta content="first" name="description">', "first"), ("<meta name=description content=bare>", "bare"), ("<meta name='description' content=\"it's up > now\">", "it's up > now"),
        ('<META NAME="Description" CONTENT="caps">', "caps"), ('<meta name="description" content=""><meta property="og:description" content="og">', "og"), ('<meta name="keywords" content="no">', None), ('<meta charset="x"><meta data-name="description" content="no">', None), ("", None), (None, None),
        ('<meta property=og:description content="a &amp; b"/>', "a & b"),
    ]
    got = spark.createDataFrame(pages, "h string, want string").select("want", meta_description(F.col("h")).alias("m")).collect()
    assert all(r.m == r.want for r in got), got
    rows = spark.createDataFrame([(k, s, '<meta name="description" content="from the page">') for k, s in enumerate([None, "own", "", " ", None])], "id int, snippet string, html string")
    assert [r.snippet for r in enriched(rows, "snippet", "html", 2, "id").orderBy("id").collect()] == ["from the page", "own", "from the page", " ", None]
    assert enriched(rows, "snippet", "html", None).filter("snippet = 'from the page'").count() == 4


def test_broken_cache_is_made_again(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "part-0.parquet").write_text("half")
    assert read_through(spark, str(tmp_path / "t"), lambda: spark.range(3)).count() == 3


def test_broadcast_is_bounded_by_bytes(spark):
    from marlstone.session import small_side

    hinted = lambda df, **k: "ResolvedHint" in small_side(df, **k)._jdf.queryExecution().analyzed().toString()
    df = spark.createDataFrame([("x" * 1000, 1)] * 5, "v string, n int")
    assert hinted(df) and not hinted(df, max_bytes=4000) and not hinted(df, max_rows=4) and hinted(df.limit(0))


def test_late_rows_and_resumed_stream(spark, tmp_path):
    from datetime import datetime

    schema = "ts timestamp, k string, v double"
    put = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    put("a", [(datetime(2024, 1, 5), "k", 1.0), (datetime(2024, 3, 1), "k", 2.0)])
    run = lambda: {(str(r.week), r.n) for r in run_available(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], schema).schema, str(tmp_path / "w"), "ts", "k", "v").collect()}
    assert run() == {("2024-01-05", 1), ("2024-03-01", 1)}
    put("b", [(datetime(2024, 1, 4), "k", 9.0), (datetime(2024, 2, 29), "k", 5.0)])  # the first is too late, the second in time
    assert run() == {("2024-01-05", 1), ("2024-03-01", 2)}
