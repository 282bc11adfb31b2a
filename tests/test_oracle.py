"""Every query with a DuckDB counterpart gives the same values; the others give rows."""

import pytest
from compare import compare, connect

from offerloom import plans, registry

plans.load()


@pytest.fixture(scope="session")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_values(spark, con, sf, name):
    problem, _ = compare(spark, con, sf, registry.QUERIES[name], registry.ORACLES[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - {"ml09_random_search", "ml08_train_boosted"}))
def test_gives_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).limit(1).count() == 1


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
