"""Trailing totals and the weekly grid against brute force."""

import random
from datetime import date, datetime, timedelta

import pytest

from marlstone.operators.regrid import regrid_weekly
from marlstone.operators.trailing import trailing_totals

SCHEMA = "coin string, day date, v double, w double, loaded timestamp, entity string, days_7 int"


def readings(seed, coins=5, hot=False):
    rng = random.Random(seed)
    rows = []
    for c in range(coins):
        start = date(2021, 1, 1) + timedelta(days=rng.randrange(300))
        for _ in range(400 if hot and c == 0 else 40):
            d = start + timedelta(days=rng.randrange(900))
            v = rng.choice([None, float("nan"), 1.0, 2.5, rng.random() * 100])
            rows.append((f"c{c}", d, v, rng.choice([None, rng.random()]), datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(50)), "x", 9))
    rows += [(None, date(2021, 1, 1), 1.0, 1.0, None, "x", 1), ("c0", None, 1.0, 1.0, None, "x", 1), ("c0", rows[0][1], 3.0, None, None, "x", 1)] + rows[:5]
    return rows


def latest(rows):
    best = {}
    for c, d, v, w, at, *_ in rows:
        if c is None or d is None or v is None or v != v:
            continue
        rank = (at is not None, at or datetime.min, v, w is not None, w or 0)
        if (c, d) not in best or rank > best[c, d][0]:
            best[c, d] = (rank, v, w)
    return {k: (v, w) for k, (_, v, w) in best.items()}


@pytest.mark.parametrize("seed,hot,tile", [(1, False, 256), (2, True, 64), (3, False, 29)])
def test_trailing(spark, seed, hot, tile):
    rows = readings(seed, hot=hot)
    best = latest(rows)
    out = trailing_totals(spark.createDataFrame(rows, SCHEMA), "coin", "day", ["v", "w"], (7, 30), "loaded", tile_days=tile, block_entities=2).collect()
    days = {c: sorted(d for e, d in best if e == c) for c in {c for c, _ in best}}
    assert {(r.entity, r.day) for r in out} == {(c, ds[0] + timedelta(k)) for c, ds in days.items() for k in range((ds[-1] - ds[0]).days + 1)}
    assert len(out) == len({(r.entity, r.day) for r in out})
    for r in out:
        for s in (7, 30):
            seen = [best[r.entity, r.day - timedelta(k)] for k in range(s) if (r.entity, r.day - timedelta(k)) in best]
            assert r[f"days_{s}"] == len(seen)
            for i, name in enumerate("vw"):
                xs = [x[i] for x in seen if x[i] is not None]
                assert (r[f"{name}_sum_{s}"] is None) == (not xs)
                if xs:
                    assert r[f"{name}_sum_{s}"] == pytest.approx(sum(xs)) and r[f"{name}_avg_{s}"] == pytest.approx(sum(xs) / len(xs))


def test_trailing_empty(spark):
    assert trailing_totals(spark.createDataFrame([], SCHEMA), "coin", "day", ["v"], loaded="loaded").count() == 0


def friday(d):
    return d + timedelta(days=(4 - d.weekday()) % 7)


@pytest.mark.parametrize("cumulative", [False, True])
def test_grid(spark, cumulative):
    rows = [r for r in readings(4) if r[0] != "c1"] + [("c1", date(2022, 3, 2), 5.0, 0.5, None, "x", 1)]
    if cumulative:
        rows = [(c, d, None if v is None or v != v else round(v), w, *rest) for c, d, v, w, *rest in rows]
        rows = [(c, d, None if v is None else float(v), *rest) for c, d, v, *rest in rows]
    best = latest(rows)
    out = {(r.entity, r.week): r for r in regrid_weekly(spark.createDataFrame(rows, SCHEMA), "coin", "day", "v", "w", "loaded", cumulative=cumulative).collect()}
    want = {}
    for c in {c for c, _ in best}:
        ds = sorted(d for e, d in best if e == c)
        weeks = [friday(ds[0]) + timedelta(7 * k) for k in range((friday(ds[-1]) - friday(ds[0])).days // 7 + 1)]
        amount = {w: [] for w in weeks}
        for k, d in enumerate(ds):
            v = best[c, d][0]
            begin = max(ds[k - 1] if k else friday(d) - timedelta(7), d - timedelta(7))
            step = v if not cumulative else None if k == 0 else v - best[c, ds[k - 1]][0] if v >= best[c, ds[k - 1]][0] else v
            span = [begin + timedelta(j) for j in range(1, (d - begin).days + 1)]
            for x in span:
                amount[friday(x)].append(None if step is None else step / len(span))
        for w in weeks:
            known = [x for x in amount[w] if x is not None]
            want[c, w] = (sum(friday(d) == w for d in ds), len(amount[w]), sum(known) if known else None)
    assert out.keys() == want.keys()
    for k, (n, days, total) in want.items():
        r = out[k]
        assert (r.readings, r.covered_days) == (n, days)
        assert r.status == ("observed" if n else "apportioned" if days else "uncovered")
        assert r.amount == (None if total is None else pytest.approx(total))
    if not cumulative:
        assert sum(r.amount or 0 for r in out.values()) == pytest.approx(sum(v for v, _ in best.values()))


def test_grid_empty(spark):
    assert regrid_weekly(spark.createDataFrame([], SCHEMA), "coin", "day", "v", "w", "loaded").count() == 0


def test_infinite_readings_are_missing(spark):
    rows = [("a", date(2021, 1, 1), float("inf"), 1.0), ("a", date(2021, 1, 2), 2.0, float("-inf")), ("a", date(2021, 1, 3), 3.0, 1.0)]
    out = {r.day: r for r in trailing_totals(spark.createDataFrame(rows, "coin string, day date, v double, w double"), "coin", "day", ["v", "w"]).collect()}
    assert set(out) == {date(2021, 1, 2), date(2021, 1, 3)} and out[date(2021, 1, 3)].v_sum_7 == 5.0 and out[date(2021, 1, 2)].w_sum_7 is None
