"""Every registered query equals its DuckDB SQL oracle on the sf0.01 tables."""

import pytest

from conftest import SF01
from tidemark.plans.catalog import QUERIES
from tidemark.plans.compare import compare, duckdb_connection
from tidemark.plans.oracle import SQL


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF01)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF01)
    res = compare(df, con, SQL[name])
    assert res["match"] and res["columns_match"] and "type_diffs" not in res, res


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.oracle_sql())
