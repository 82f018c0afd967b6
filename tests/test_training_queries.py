"""The training queries run the operators' own jobs: no smaller model, search, window or ratio."""

import inspect

import pytest

from cardwatch.catalog import QUERIES, queries
from cardwatch.plans import retrain, training


class Stop(Exception):
    pass


def passed(monkeypatch, module, name, spark, sf_dir, query):
    """The arguments, defaults included, with which a query calls an operator."""
    seen, signature = {}, inspect.signature(getattr(module, name))

    def stop(*args, **options):
        bound = signature.bind(*args, **options)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise Stop

    monkeypatch.setattr(module, name, stop)
    with pytest.raises(Stop):
        QUERIES[query](spark, sf_dir)
    return seen


@pytest.fixture(autouse=True)
def rows_as_they_are(monkeypatch):
    monkeypatch.setattr(queries, "training_rows", lambda spark, sf_dir: queries.ft.engineered(queries.fixture.raw_transactions(spark, sf_dir)))


@pytest.mark.parametrize("query", ["boosted_trees", "balanced_boosted_trees", "graph_boosted_trees", "cross_validation", "feature_set_sweep", "sampling_sweep", "initial_model", "random_forest"])
def test_models_of_full_size(monkeypatch, spark, sf_dir, query):
    learners = []

    def stop(df, columns, learner, **weighting):
        learners.append(learner)
        raise Stop

    monkeypatch.setattr(training, "_fit", stop)
    with pytest.raises(Stop):
        QUERIES[query](spark, sf_dir)
    trees = [x for x in learners if x.hasParam("maxDepth")]
    assert trees
    for learner in trees:
        number = learner.getNumTrees() if query == "random_forest" else learner.getMaxIter()
        assert (number, learner.getMaxDepth()) == (100, 6)


def test_search_of_full_size(monkeypatch, spark, sf_dir):
    seen = passed(monkeypatch, training, "search", spark, sf_dir, "hyper_parameter_search")
    assert (seen["n_trials"], seen["folds"]) == (20, 5) and seen["space"] is training.SEARCH_SPACE


def test_cycle_searches_in_full(monkeypatch, spark, sf_dir):
    seen = passed(monkeypatch, retrain, "daily_cycle", spark, sf_dir, "daily_cycle")
    assert seen["n_trials"] == 100 and not seen["search_options"]


def test_initial_model_reads_thirty_days(monkeypatch, spark, sf_dir):
    assert passed(monkeypatch, training, "train_initial", spark, sf_dir, "initial_model")["days"] == 30


def test_sampling_ratios(monkeypatch, spark, sf_dir):
    assert passed(monkeypatch, training, "sampling_sweep", spark, sf_dir, "sampling_sweep")["ratios"] == (0.05, 0.10)
