"""Every query of the registry against its SQL oracle, and the driver's entry points."""

import pytest
from conftest import rows_of, rows_of_duck

import __spark_entry__
from wayfold.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_oracle(spark, data, duck, name):
    got, want = rows_of(QUERIES[name](spark, data)), rows_of_duck(duck.sql(SQL[name]))
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "episode" in df.columns


#: Queries that SQL cannot express, each held against a plain loop in a test of its own.
LOOPS = {"cohort_queues", "cover_selection", "dataset_build", "mix_selection", "perturbed_prefixes"}


def test_every_query_has_an_oracle_or_a_test(spark, data):
    assert set(SQL) == set(QUERIES) - LOOPS
    assert all(QUERIES[name](spark, data).count() for name in LOOPS)
    assert set(__spark_entry__.queries()) >= set(QUERIES)
