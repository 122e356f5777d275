"""The driver's contract."""

import __spark_entry__ as entry
from marlstone.plans import registry


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["coin", "week"] and df.count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.SQL) <= set(registry.QUERIES)
    assert {f"p{n}_found" for n in (2, 3, 5, 6)} <= set(registry.QUERIES)


def test_found_columns(spark, folder):
    want = {"p2_found": {"line_id": "bigint", "reason": "string"}, "p3_found": {"tbl": "string", "coin": "string", "day_text": "string", "span": "int"}, "p5_found": {"tbl": "string", "row_id": "bigint", "utc_text": "string"}, "p6_found": {"coin": "string", "week_text": "string"}}
    for name, columns in want.items():
        assert dict(registry.QUERIES[name](spark, folder).dtypes) == columns
