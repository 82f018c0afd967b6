"""The search races its trials; runs, models and the champion are stored and read back."""

import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cardwatch.operators import features as ft
from cardwatch.plans import champions, retrain, training
from cardwatch.session import durable, scratch_path
from cardwatch.streaming import queue


@pytest.fixture(scope="module")
def rows(fact):
    return durable(ft.engineered(fact).limit(2_000), "few-rows")


def test_rungs_end_with_all_folds_and_trees():
    assert training.rungs(20, 5) == [(20, [0], 0.25), (5, [1], 0.5), (2, [0, 1, 2, 3, 4], 1.0)]
    for n in (1, 2, 3, 17, 100):
        steps = training.rungs(n, 3)
        assert steps[0][0] == n and steps[-1][1:] == ([0, 1, 2], 1.0) and all(a[0] > b[0] for a, b in zip(steps, steps[1:]))


def test_search_and_promotion(spark, rows):
    asked = []
    fit = training._fit_vectors
    space = {"trees": lambda r: r.choice([2, 4]), "depth": lambda r: r.randint(2, 3)}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(training, "_fit_vectors", lambda vectors, params: asked.append((vectors.count(), params)) or fit(vectors, params))
        found = training.search(rows, n_trials=3, space=space, ratio=0.5, folds=2)
    trials = found.trials.collect()
    assert sorted(t.n_folds for t in trials) == [1, 1, 2] and found.best == max((t for t in trials if t.rung == 1), key=lambda t: t.mean_f2_class_1).params
    # the last fit reads every labelled row of the training part that the ratio asks for
    train, test = training.stratified_split(rows, 0.2)
    assert asked[-1] == (training.rebalance(train, 0.5).count(), found.best)
    matrix = found.figures.first()
    assert test.count() == sum(matrix[name] for name in ("tn", "fp", "fn", "tp"))
    registry = champions.Registry(spark, scratch_path(spark, "registry"))
    assert registry.newest() is None and registry.champion().count() == 0 and registry.champion_model() is None
    assert retrain.keep_best(registry, "e", found, datetime(2024, 1, 2))
    stored, version = registry.champion_model()
    assert version == 1 and training.score(test, stored).exceptAll(training.score(test, found.model)).isEmpty()


def test_search_refits_beside_the_last_folds(rows, monkeypatch):
    """Two trials, two folds: four fits and two refits wait for each other, so none may be left for the end."""
    fit, met, tasks = training._fit_vectors, threading.Barrier(6, timeout=300), []

    def together(vectors, params):
        tasks.append(vectors.rdd.getNumPartitions())
        met.wait()
        return fit(vectors, params)

    monkeypatch.setattr(training, "_fit_vectors", together)
    monkeypatch.setattr(training, "ROWS_PER_TASK", 100)
    draws = iter([1, 3])
    found = training.search(rows, n_trials=2, space={"trees": lambda r: next(draws), "depth": lambda r: 2}, ratio=0.5, folds=2)
    assert [(t.rung, t.n_folds) for t in found.trials.collect()] == [(0, 2), (0, 2)]
    assert found.model.pipeline.stages[-1].getNumTrees == found.best["trees"]
    # 2 tasks a core in all, not one for each 100 rows
    assert all(n <= -(-2 * rows.sparkSession.sparkContext.defaultParallelism // 6) for n in tasks)


def test_fit_tasks():
    assert [training.fit_tasks(384_000, 12, fits) for fits in (1, 5, 12, 20)] == [8, 5, 2, 2]
    assert training.fit_tasks(0, 12, 1) == 1 and training.fit_tasks(4_000_000, 12, 20) == 4


def test_one_champion_at_a_time(spark, rows):
    registry = champions.Registry(spark, scratch_path(spark, "registry"))
    model = training.train_lr(rows, ["amt", "category"], iterations=2)
    low, high, other = (registry.record("e", name, model, {"f2_class_1": figure}, {}, datetime(2024, 1, n)) for n, (name, figure) in enumerate([("low", 0.2), ("high", 0.6), ("other", 0.6)], 1))
    assert registry.challenge(low, 0.2)
    seen = registry.newest()
    assert registry.challenge(high, 0.6) and not registry.challenge(other, 0.6) and not registry.challenge(low, 0.2)
    with pytest.raises(champions.Refused):
        registry.promote(other, 0.9, seen)  # decided before `high` was named
    assert registry.newest() == {"number": 2, "run_id": high, "figure": 0.6}
    assert {r.run_name: r.champion for r in registry.runs().collect()} == {"low": False, "high": True, "other": False}
    assert registry.champion().first().run_id == high
    assert registry.champion_model()[0].columns == ["amt", "category"]
    assert registry.runs().filter(F.col("champion").isNull()).isEmpty()


def test_a_stream_keeps_its_model(spark, rows):
    registry, checkpoint = champions.Registry(spark, scratch_path(spark, "registry")), scratch_path(spark, "checkpoint")
    assert queue.pinned_scorer(registry, checkpoint) is queue.unscored
    first, second = training.train_lr(rows, ["amt"], iterations=3), training.train_lr(rows, ["city_pop"], iterations=3)
    registry.challenge(registry.record("e", "first", first, {}, {}, datetime(2024, 1, 1)), 0.1)
    scored = queue.pinned_scorer(registry, checkpoint)(rows)
    assert registry.challenge(registry.record("e", "second", second, {}, {}, datetime(2024, 1, 2)), 0.2)
    again = queue.pinned_scorer(registry, checkpoint)(rows)  # as after a restart
    assert again.exceptAll(scored).isEmpty() and again.exceptAll(training.score(rows, first, 1)).isEmpty()
    other = queue.pinned_scorer(registry, scratch_path(spark, "checkpoint"))(rows)
    assert {r.model_version for r in other.select("model_version").distinct().collect()} == {"fraud_detector_v2"}
