"""Every registered query against its SQL, and what its physical plan must not hold."""

from __future__ import annotations

import inspect
import re
import sys

import pytest

from conftest import ROOT, SMALL, executed_plan

sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as contract  # noqa: E402
from compare import database, differences  # noqa: E402


@pytest.fixture(scope="module")
def connection():
    return database(SMALL)


@pytest.mark.parametrize("name", list(contract._QUERIES))
def test_query_agrees_with_its_sql(spark, connection, name):
    df = contract.queries()[name](spark, SMALL)
    assert differences(spark, connection, name, SMALL, df) is None
    # No cross join and nothing in Python.
    assert not re.search("CartesianProduct|NestedLoop|Python|Pandas", executed_plan(df))


def test_every_query_has_its_sql():
    assert set(contract._QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_flagship(spark):
    assert contract.entry(spark).count() == 8


def test_filters_and_columns_reach_the_scan(spark, lake):
    from mercato.plans.analytics import monthly_revenue_trend

    plan = executed_plan(monthly_revenue_trend(lake))
    assert "EqualTo(order_status,delivered)" in plan
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert sorted(len(scan.split(",")) for scan in scans) == [3, 6]


def test_nothing_local_or_random_in_the_library():
    banned = "localCheckpoint|toPandas|crossJoin|pandas_udf|applyInPandas|mapInPandas"
    for file in (ROOT / "mercato").rglob("*.py"):
        if "llm" in file.parts:
            continue
        assert not re.search(banned, file.read_text()), file
    assert not re.search(banned, inspect.getsource(contract))
