"""Queries beside their SQL on the smallest tables."""

import pytest

from marlstone.llm import queries
from tests.verify import compare, connect


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, folder, name):
    said, _ = compare(spark, connect(folder), folder, name, queries.QUERIES[name], queries.SQL[name])
    assert said.startswith("equal"), said


@pytest.mark.parametrize("name,columns", [("p1_found", {"article_id", "field"}), ("p4_found", {"keep_id", "copy_id"}), ("p9_found", {"doc_id", "end_pos"})])
def test_columns(spark, folder, name, columns):
    df = queries.QUERIES[name](spark, folder)
    assert set(df.columns) == columns and df.count() > 0
