import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from workload.check import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    started = session("4")
    started.sparkContext.setLogLevel("ERROR")
    yield started
    started.stop()


@pytest.fixture(scope="session")
def sf():
    return SMALL


def plan_of(df) -> str:
    """The executed plan as text."""
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def values(df, *columns):
    return [tuple(row[c] for c in columns) for row in df.collect()]
