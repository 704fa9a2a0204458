"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect

from tidemark.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
SLOW = {"i1_snapshot_import", "i14_streamed_import"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query_matches_sql(spark, con, sf, name):
    problem, _, _ = compare(spark, con, sf, QUERIES[name], ORACLES.get(name))
    assert problem is None, problem


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_is_stable(spark):
    from __spark_entry__ import entry

    assert entry(spark).columns == ["position", "server_version_id", "change"]
