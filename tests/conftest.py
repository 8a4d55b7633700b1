from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from mercato.session import local_session  # noqa: E402
from mercato.sources.sample import raw_tables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="8g", name="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw(spark):
    return raw_tables(spark, SMALL)


@pytest.fixture(scope="session")
def lake(spark):
    import __spark_entry__ as contract

    return contract._lake(spark, SMALL)


def executed_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
