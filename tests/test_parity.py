"""Registered queries beside their oracle SQL."""

import re

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, compare

SF = "/root/testdata/sf0.001"
OTHERS = re.compile(r"op\d+_|pipeline$")  # these have tests of their own
NAMES = [n for n in contract.oracle_sql() if not OTHERS.match(n) and not n.startswith("m_")]  # models at full size: check.py


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    assert compare(spark, duck, SF, name, contract.queries()[name], contract.oracle_sql()[name]) == ""


def test_contract():
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries)
    assert not {n for n in queries if n not in oracles and not OTHERS.match(n)}


def test_entry(spark):
    assert contract.entry(spark).count() > 0
