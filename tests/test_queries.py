"""Every registered query against its SQL on the smallest tables."""

import pytest

from cardwatch.catalog import ORACLE, QUERIES
from check import connect, differences

SLOW = {"sampling_sweep", "feature_set_sweep", "hyper_parameter_search", "cross_validation", "daily_cycle", "random_forest",
        "graph_boosted_trees", "graph_linear", "balanced_boosted_trees", "initial_model"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert differences(QUERIES[name](spark, sf_dir), duck, ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_query_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_sql_only_for_known_queries():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
