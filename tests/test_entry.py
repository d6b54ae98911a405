"""The driver contract."""

import re

import __spark_entry__ as contract
from tidemark.queries import ORACLES, QUERIES


def test_flagship_query_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_query_names():
    assert len(QUERIES) >= 150 and not [n for n in QUERIES if n == "pipeline" or re.match(r"op\d", n)]


def test_no_filled_in_marks_are_left_in_the_sql():
    assert not [n for n, sql in ORACLES.items() if re.search(r"\{[a-z_]+\}", sql) and "type" not in n]
