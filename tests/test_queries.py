"""Every query of the engine against its SQL; those without SQL must run and give rows that can be told apart."""

import pytest

from quillon.plans import catalogue as cat
from tests.oracle import check, connect

EMPTY_IS_RIGHT = {"offers", "facet_integrity"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(cat.ORACLES))
def test_like_sql(spark, con, sf, name):
    check(spark, con, sf, cat.QUERIES[name], cat.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(cat.QUERIES) - set(cat.ORACLES)))
def test_runs(spark, sf, name):
    df = cat.QUERIES[name](spark, sf)
    assert df.columns and (df.collect() or name in EMPTY_IS_RIGHT)


def test_entry_without_llm(spark, monkeypatch):
    """The entry point works where the llm folders are gone."""
    import importlib
    import sys

    import __spark_entry__ as entry

    for gone in ("corpus_pipeline", "quillon.llm", "quillon.llm.queries"):
        monkeypatch.setitem(sys.modules, gone, None)
    try:
        bare = importlib.reload(entry)
        assert set(bare.queries()) == set(cat.QUERIES) and bare.entry(spark).count() > 0
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
