"""Packing and mixing: invariants, and nothing lost."""

import re

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm.mixing import mix_sources
from marlstone.llm.packing import dot_product_pack, pack_documents
from marlstone.llm.tokens import default_tokenizer, token_counts
from marlstone.sources.tables import table


def test_token_counts_agree_between_libraries(folder):
    import duckdb
    import public_tokenizers

    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{folder}/documents.parquet'").fetchall()] + [None, "", "<|endoftext|> a", "x" * 100_000]
    assert token_counts(texts, default_tokenizer()) == token_counts(texts, str(public_tokenizers.path("byte_bpe_50k.json")))
    assert token_counts(["Hello there"], str(public_tokenizers.path("piece_bpe_32k.model")))[0] > 1


def test_kernel_keeps_all_limits():
    rng = np.random.default_rng(1)
    for n in (0, 1, 300):
        sizes = np.column_stack([rng.integers(1, 60, n), np.ones(n), rng.integers(0, 50, n)]).astype(float)
        limits = np.array([100.0, 7, 90])
        bins = dot_product_pack(sizes, limits)
        assert (bins >= 0).all()
        for b in set(bins):
            assert (sizes[bins == b].sum(axis=0) <= limits + 1e-9).all()
        if n > 100:
            assert len(set(bins)) <= 1.05 * max((sizes.sum(axis=0) / limits).max(), 1) + 1


def check_pack(spark, docs, capacities, **options):
    out = pack_documents(docs, capacities, **options).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    sizes = dict(zip(texts, token_counts(list(texts.values()), default_tokenizer())))
    heads = {k: m.group(1) if t and (m := re.match(r"([^\n]+\n\s*\n)", t)) and len(m.group(1)) < len(t) else "" for k, t in texts.items()}
    prompts = dict(zip(heads, token_counts(list(heads.values()), default_tokenizer())))
    for c, room in {r.capacity_id: r.capacity_tokens for r in capacities.collect()}.items():
        loss_room = max(1, int(room * options.get("max_loss", 1.0)))
        rows = [r for r in out if r.capacity_id == c]
        mine, bins = {}, {}
        for r in rows:
            mine.setdefault(r.doc_id, []).append(r)
            bins.setdefault(r.bin, []).append(r)
        for doc, size in sizes.items():
            pieces = sorted((r.piece, r.tokens, r.loss) for r in mine.get(doc, []))
            loss = size - min(size, prompts[doc])
            assert sum(t for _, t, _ in pieces) == size and sum(x for *_, x in pieces) == loss and [p for p, *_ in pieces] == list(range(len(pieces)))
            assert len(pieces) == (0 if not size else 1 if size <= room and loss <= loss_room else -(-size // min(room, loss_room)))
        for b in bins.values():
            assert sum(r.tokens for r in b) <= room and len(b) <= options.get("max_segments", max(1, room // 16)) and sum(r.loss for r in b) <= loss_room
    return out


def test_pack(spark, folder):
    check_pack(spark, table(spark, folder, "documents"), table(spark, folder, "pack_capacity"))


def test_pack_under_tight_limits(spark, folder):
    check_pack(spark, table(spark, folder, "documents"), table(spark, folder, "pack_capacity"), max_segments=5, max_loss=0.6)


def test_pack_edges(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "a"), (4, "word " * 5000), (5, "Title\n\nBody of it"), (6, "a"), (7, "\n\n")], "doc_id long, text string").withColumn("bin", F.lit("x")).withColumn("tokens", F.lit(1))
    caps = spark.createDataFrame([(1, 50), (2, 4), (3, 0), (4, None)], "capacity_id int, capacity_tokens int")
    out = check_pack(spark, docs, caps.filter("capacity_tokens > 0"), max_segments=2)
    assert {r.capacity_id for r in out} == {1, 2}
    prompt = [r for r in out if r.doc_id == 5 and r.capacity_id == 1]
    assert prompt[0].loss < prompt[0].tokens
    assert pack_documents(docs.limit(0), caps).count() == 0


def test_mix(spark, folder):
    docs, targets = table(spark, folder, "documents"), table(spark, folder, "source_targets")
    chosen, report = mix_sources(docs, targets)
    rows, rep = chosen.collect(), {r.source: r for r in report.collect()}
    assert len({r.doc_id for r in rows}) == len(rows)
    total = sum(r.tokens * r.repeats for r in rows)
    for s, r in rep.items():
        mine = [x for x in rows if x.source == s]
        assert sum(x.tokens * x.repeats for x in mine) == r.tokens and r.most_repeats <= r.max_repeats
        largest = max((x.tokens for x in mine), default=0)
        assert abs(r.tokens - r.budget_tokens) <= max(largest, 2000)
        assert abs(r.reached_share - r.tokens / total) < 1e-12
    assert len(rep) == 14 and rep["bridgeledger.example"].tokens == 0


def test_mix_repeats_and_edges(spark):
    docs = spark.createDataFrame([(k, "word " * 100, "big") for k in range(300)] + [(1000 + k, "word " * 100, "small") for k in range(10)] + [(2000, None, "big"), (2001, "", "big"), (2002, "x", None), (2003, "x", "unlisted"), (0, "word " * 100, "big")], "doc_id long, text string, source string").withColumn("repeats", F.lit("x"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("none", None, 2), (None, 0.1, 1), ("absent", 0.2, 5)], "source string, target_share double, max_repeats int")
    chosen, report = mix_sources(docs, targets)
    rep = {r.source: r for r in report.collect()}
    assert rep["small"].most_repeats == 3 and rep["small"].documents == 10
    assert abs(rep["big"].tokens - rep["small"].tokens) <= 110
    chosen, report = mix_sources(docs, targets, total_tokens=10**9)
    rep = {r.source: r for r in report.collect()}
    assert rep["big"].documents == 301 and rep["big"].most_repeats == 1 and rep["small"].most_repeats == 3
    chosen, report = mix_sources(docs.limit(0), targets)
    assert chosen.count() == 0 and {r.tokens for r in report.collect()} == {0}


def test_binding_limits_keep_texts_whole(spark, folder):
    from collections import defaultdict

    from marlstone.llm.queries import p7_limits

    capacity = {r.capacity_id: r.capacity_tokens for r in table(spark, folder, "pack_capacity").filter("capacity_tokens > 0").collect()}
    size, bins, bound = defaultdict(int), defaultdict(list), 0
    rows = p7_limits(spark, folder).collect()
    for r in rows:
        size[r.capacity_id, r.doc_id] += r.tokens
        bins[r.capacity_id, r.bin].append(r)
    pieces = defaultdict(int)
    for r in rows:
        pieces[r.capacity_id, r.doc_id] += 1
    ids = [r.doc_id for r in table(spark, folder, "documents").select("doc_id").collect()]
    twice = {i for i in ids if ids.count(i) > 1} if len(ids) < 2000 else set()
    assert all(n == 1 for (c, doc), n in pieces.items() if doc not in twice and size[c, doc] <= capacity[c])
    for (c, _), b in bins.items():
        limit = max(1, int(capacity[c] * 0.8))
        loss = sum(r.loss for r in b)
        assert sum(r.tokens for r in b) <= capacity[c] and len(b) <= 8 and (loss <= limit or len(b) == 1)
        bound += loss > limit
    assert bound
