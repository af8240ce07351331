"""Every registered query against DuckDB on the same tables (rows-only where SQL cannot say it)."""

import pytest
from check_oracle import compare, connect

from rasterspark import registry

registry.load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, sf_dir, name):
    problem = compare(spark, con, name, sf_dir)
    assert problem == "" or problem.startswith("rows-only"), problem


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["row", "col", "r", "g", "b", "a"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
