"""Registered queries against their SQL, and that all are registered."""

import pytest

from quillon.llm.queries import ORACLES, QUERIES
from tests.oracle import check, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_like_sql(spark, sf, name):
    check(spark, connect(sf), sf, QUERIES[name], ORACLES[name])


def test_registered(spark, sf):
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
