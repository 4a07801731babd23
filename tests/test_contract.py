"""Every registered query runs on the smallest tables and equals its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__
from annalist.plans import catalog
from tests.compare import assert_same, engine

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return engine(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        assert_same(df, con, catalog.ORACLES[name])
    else:
        assert df.count() > 0


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(catalog.QUERIES) <= set(__spark_entry__.queries())
