"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks import CHECKS
from run_checks import compare
from tests.conftest import SMALL


@pytest.mark.parametrize("name", list(CHECKS))
def test_query_matches_sql(spark, duck, name):
    ok, note = compare(spark, duck, SMALL, name)
    assert ok, note


def test_contract(spark):
    assert CHECKS.keys() <= queries().keys()
    assert CHECKS.keys() <= oracle_sql().keys() <= queries().keys()
    assert entry(spark).columns == ["rule_id", "start_ms", "end_ms", "duration_ms", "status"]
