"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import driver_queries
from tests.check_queries import compare, duck
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    problem, _ = compare(spark, con, SF_SMALL, entry.queries()[name], entry.oracle_sql().get(name))
    assert problem is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_repeated_name_is_refused():
    def self_runs(spark, sf_dir):
        return None

    with pytest.raises(ValueError, match="self_runs"):
        driver_queries.query()(self_runs)
    assert driver_queries.QUERIES["self_runs"] is not self_runs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
