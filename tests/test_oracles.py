"""Every registered query next to its SQL, at the smallest scale."""

import pytest

from workload.check import compare, database
from workload.oracles import ORACLES
from workload.queries import QUERIES

TRAINING = {"full_experiment", "train_random_forest", "feature_importance"}
SLOW = TRAINING | {f"{name}_checked" for name in TRAINING}


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, sf, name):
    assert compare(spark, con, sf, name) == ""
