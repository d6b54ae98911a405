"""Every registered query against its SQL."""

import pytest

from tests.compare import connect, difference
from tidemark.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    result = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert difference(result, duck, ORACLES[name]) == ""
    else:
        assert result.count() >= 0
