"""Queries of the subpackage against their SQL."""

import pytest

from scatterframe.llm.catalog import ORACLES, QUERIES
from tests.compare import compare, oracle_connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), ORACLES[name], oracle_connection(sf)) is None
