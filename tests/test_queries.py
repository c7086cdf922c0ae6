"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import __spark_entry__ as entry
import check
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(name, spark, con):
    ok, text = check.compare(name, spark, con, SF)
    assert ok, text


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
