"""Every registered query against its SQL check in DuckDB."""

from __future__ import annotations

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
from beatwatch.plans import all_entries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


# at this scale no two events of one minute exist, no group is large enough, no page that deep
MAY_BE_EMPTY = {"pag1b", "str6", "str6b", "str7", "agg3", "top3c", "str4", "str4b", "snk5"}


@pytest.mark.parametrize("name", sorted(all_entries()))
def test_query_matches_sql(spark, duck, name):
    problem = compare(spark, duck, SF, entry.queries()[name], entry.oracle_sql().get(name))
    assert problem == "" or (problem == "both empty" and name in MAY_BE_EMPTY)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["district", "total_events", "avg_severity", "critical_count", "last_seen"]
    assert df.count() > 0


def test_every_query_has_a_sql_check():
    assert all(e.sql for e in all_entries().values())
    assert set(all_entries()) <= set(entry.queries())
