"""The registered training-data queries equal their SQL."""

from __future__ import annotations

import pytest

from annalist.llm import queries
from tests.compare import assert_same, engine

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), engine(SF), queries.ORACLES[name])


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
