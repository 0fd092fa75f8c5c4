"""Every registered query next to its check statement; row checks for the rest."""

import check
import pytest

import __spark_entry__ as E

QUERIES, ORACLES = E.queries(), E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return check.oracle_connection(sf_dir)


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_check(spark, con, sf_dir, key):
    ok, message, _t1, _t2 = check.compare(spark, con, key, QUERIES[key], ORACLES[key], sf_dir)
    assert ok, message


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES) - {"n3_stages"}))
def test_runs(spark, sf_dir, key):
    assert QUERIES[key](spark, sf_dir).count() > 0


def test_entry(spark):
    assert E.entry(spark).count() > 0
