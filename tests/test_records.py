"""Failing records and written dates, against plain Python."""

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from marlstone.functions.timestamps import parse_dates
from marlstone.operators.moments import host_source, normalise_dates
from marlstone.operators.records import load_records
from marlstone.sources.tables import table


def plain_fields(line):
    """(fields, well formed) by a character loop."""
    fields, k, n = [], 0, len(line)
    while True:
        if k < n and line[k] == '"':
            k += 1
            out = ""
            while True:
                if k >= n:
                    return fields + [out], False
                if line[k] == '"':
                    if line[k + 1 : k + 2] == '"':
                        out += '"'
                        k += 2
                        continue
                    k += 1
                    if k < n and line[k] != "\t":
                        return fields + [out], False
                    break
                out += line[k]
                k += 1
        else:
            end = line.find("\t", k)
            end = n if end < 0 else end
            out, k = line[k:end], end
        fields.append(out)
        if k >= n:
            return fields, True
        k += 1


LINES = [
    "2021-01-01\tplain", '2021-01-01\t"quoted"', '2021-01-01\t"a ""b"" c"', '2021-01-01\t"open', '2021-01-01\t"lone " quote"', '2021-01-01\t"tab\tinside"', '2021-01-01\t"line\nbreak"', '"2021-01-01"\tquoted date',
    '2021-01-01\t"closed" rest', "2021-01-01\tone\ttwo", "no tab", '2021-01-01\tmid " quote', "\ttext", "2021-01-01\t", "2021-01-01\t  ", "2021-02-30\ttext", "yesterday\ttext", '2021-01-01\t""', '""\ttext', '2021-01-01\t"x""', '2021-01-01\t"""x"""',
    '2021-01-01\ta\t"bad', "   ", "", " ", "2021-01-01\t" + "long " * 50_000, '2021-01-01\t"' + 'x""' * 20_000 + '"', "2021-01-01\tplain", '"', '"\t"', "\t",
]


def test_reasons(spark):
    df = spark.createDataFrame([(k, v, "e") for k, v in enumerate([*LINES, None])], "line_id long, line string, reason string")
    valid, failed = load_records(df)
    got = {r.line_id: r.reason for r in failed.collect()}
    loaded = {r.line_id: (r.date, r.text) for r in valid.collect()}
    assert set(valid.columns) == {"line_id", "line", "reason", "date", "text"}
    for k, line in enumerate(LINES):
        if not line.strip():
            assert k not in got and k not in loaded
            continue
        fields, good = plain_fields(line)
        if not good:
            want = "quoting"
        elif len(fields) != 2:
            want = "columns"
        else:
            want = "value" if fields[0] != "2021-01-01" or not fields[1].strip() else None
        assert got.get(k) == want, (line[:60], got.get(k), want)
        if want is None:
            assert loaded[k] == tuple(fields)
    assert not set(got) & set(loaded)


def test_structure_of_all_lines(spark, folder):
    rows = table(spark, folder, "articles_raw").collect()
    valid, failed = load_records(table(spark, folder, "articles_raw"))
    got = {r.line_id: r.reason for r in failed.collect()}
    loaded = {r.line_id for r in valid.collect()}
    for r in rows:
        if not r.line.strip():
            continue
        fields, good = plain_fields(r.line)
        want = "quoting" if not good else "columns" if len(fields) != 2 else None
        assert (got.get(r.line_id) == want) if want else (got.get(r.line_id) in (None, "value"))
        assert (r.line_id in loaded) == (r.line_id not in got)


def test_no_lines(spark):
    valid, failed = load_records(spark.createDataFrame([], "line_id long, line string"))
    assert valid.count() == failed.count() == 0


def python_utc(local: datetime, zone: str) -> str:
    """First of two, skipped times moved on: fold 0 and a detour over UTC."""
    utc = local.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(timezone.utc)
    return utc.strftime("%Y-%m-%dT%H:%M:%SZ")


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Berlin", "Australia/Sydney", "Asia/Kolkata", "America/Sao_Paulo"])
def test_wall_times_across_changes(spark, zone):
    start = datetime(2023, 1, 1)
    times = [start + timedelta(minutes=30 * k) for k in range(0, 17_520, 1)]
    df = spark.createDataFrame([(t.strftime("%Y-%m-%d %H:%M:%S"),) for t in times], "d string")
    got = [r.ts_text for r in parse_dates(df, "d", F.lit(zone)).select("d", "ts_text").orderBy("d").collect()]
    assert got == [python_utc(t, zone) for t in times]


FORMS = [
    ("2021-03-04", "2021-03-04"), ("20210304", "2021-03-04"), ("04.03.2021", "2021-03-04"), ("4.3.21", "2021-03-04"), ("4 March 2021", "2021-03-04"), ("Mar 4, 2021", "2021-03-04"), ("4. März 2021", "2021-03-04"),
    ("4 de março de 2021", "2021-03-04"), ("4 марта 2021", "2021-03-04"), ("2021年3月4日", "2021-03-04"), ("04/03/2021", "2021-03-04"), ("04/03/21", "2021-03-04"), ("2021-03-04T05:06:07Z", "2021-03-04T05:06:07Z"),
    ("20210304T050607Z", "2021-03-04T05:06:07Z"), ("20210304050607", "2021-03-04T05:06:07Z"), ("2021-03-04 05:06", "2021-03-04T05:06:00Z"), ("2021-03-04T05:06:07.999999+05:30", "2021-03-03T23:36:07Z"),
    ("Thu, 04 Mar 2021 05:06:07 +0100", "2021-03-04T04:06:07Z"), ("Thu, 04 Mar 2021 05:06:07 EST", "2021-03-04T10:06:07Z"), ("2021-03-04 05:06:07 UTC-05:00", "2021-03-04T10:06:07Z"), ("1614834367", "2021-03-04T05:06:07Z"),
    ("1614834367123", "2021-03-04T05:06:07Z"), ("1614834367123456", "2021-03-04T05:06:07Z"), ("March 4, 2021 12:06 a.m.", "2021-03-04T00:06:00Z"), ("04/03/2021 12:06 PM", "2021-03-04T12:06:00Z"), (" 2021-03-04 ", "2021-03-04"),
    ("2021-02-29", None), ("2021-13-01", None), ("31/04/2021", None), ("2021-03-04 24:01", None), ("2021-03-04T11:75:00Z", None), ("0000-00-00", None), ("soon", None), ("", None), (None, None), ("2021-03-04 05:06:07 XYZ", None),
    ("2021-03-04 13:00 PM", None), ("13/25/2021", None), ("x" * 100_000, None),
]


def test_forms(spark):
    df = spark.createDataFrame([(k, d, "clash") for k, (d, _) in enumerate(FORMS)], "k int, d string, ts_text string")
    got = {r.k: r.ts_text for r in parse_dates(df, "d").collect()}
    assert [(FORMS[k][0] or "")[:40] for k in got if got[k] != FORMS[k][1]] == []


def test_sources(spark):
    sources = spark.createDataFrame([("a.example", "America/New_York", "MDY"), ("a.example", "America/New_York", "MDY"), ("b.example", "No/Where", "DMY"), (None, "Asia/Tokyo", "MDY")], "source string, tz_name string, day_order string")
    df = spark.createDataFrame([(1, "03/04/2021 10:00", "a.example", None), (2, "03/04/2021 10:00", "b.example", None), (3, "03/04/2021", None, "https://www.A.example/x?q"), (4, "03/04/2021", "other", None), (5, "13/04/2021", "a.example", None)], "k int, date string, source string, url string")
    out = {r.k: r.ts_text for r in normalise_dates(df, sources, source=F.coalesce("source", host_source(F.col("url")))).collect()}
    assert out == {1: "2021-03-04T15:00:00Z", 2: "2021-04-03T10:00:00Z", 3: "2021-03-04", 4: "2021-04-03", 5: "2021-04-13"}
    assert normalise_dates(df.limit(0), sources).count() == 0


def test_session_zone_does_not_matter(spark):
    df = spark.createDataFrame([("2021-07-04 05:06:07",)], "d string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert parse_dates(df, "d", F.lit("Europe/Berlin")).collect()[0].ts_text == "2021-07-04T03:06:07Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_all_dates_have_a_reading_or_reason(spark, folder):
    bad = [r.date for r in parse_dates(table(spark, folder, "articles_scraped"), "date").filter("ts_kind = 'format'").collect()]
    assert all(not re.search(r"\d{4}", d) or d.endswith("x") for d in bad), bad
