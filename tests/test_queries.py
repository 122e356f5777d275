"""Every core query beside its SQL on the smallest tables."""

import pytest

from marlstone.plans import registry
from tests.verify import compare, connect


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, folder, con, name):
    said, _ = compare(spark, con, folder, name, registry.QUERIES[name], registry.SQL[name])
    assert said.startswith("equal"), said


@pytest.mark.parametrize("name", ["m1_logit", "m9_panel", "h5_power", "d12_evt", "e9_bootstrap"])
def test_runs(spark, folder, name):
    assert registry.QUERIES[name](spark, folder).count() >= 0
