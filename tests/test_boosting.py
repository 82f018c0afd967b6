"""Boosted trees grown from histograms: Spark ML's trees, without a Spark job for each level."""

import uuid

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cardwatch.plans import boosting, training
from cardwatch.plans.boosting import BoostedTrees
from cardwatch.session import durable, scratch_path


@pytest.fixture(scope="module")
def rows(spark):
    """Vectors, sparse and dense, of many-valued, negative and few-valued columns, one constant; no two columns split alike."""
    draw = np.random.default_rng(7)
    made = []
    for n in range(900):
        amount, hour, place, rare = draw.normal(), float(draw.integers(24)), int(draw.integers(6)), float(draw.integers(1, 4) if draw.random() < 0.06 else 0)
        target = float(amount + 0.1 * hour + (place == 2) + rare + draw.normal() > 2.2)
        values = {0: amount, 1: hour, 3 + place: 1.0, 9: rare, 10: -3.0 if draw.random() < 0.05 else 0.0, 11: 5.0}
        values = {k: v for k, v in values.items() if v != 0.0}
        vector = Vectors.sparse(12, values)
        made.append((n, target, 2.5 if target else 1.0, 1.0, vector if n % 3 else Vectors.dense(vector.toArray())))
    return durable(spark.createDataFrame(made, ["id", "target", "w", "one", "features"]).repartition(3), "rows")


def learner(kind, weight="w", **options):
    return kind(**{"labelCol": "target", "weightCol": weight, "maxIter": 6, "maxDepth": 4, "stepSize": 0.1, "seed": 42, "checkpointInterval": 10, **options})


def scores(model, rows):
    return {r.id: float(r.probability[1]) for r in model.transform(rows).select("id", "probability").collect()}


@pytest.mark.parametrize("weight", ["w", "one"])
def test_same_trees_as_spark_ml(rows, weight):
    own, other = (learner(kind, weight, minInstancesPerNode=3).fit(rows) for kind in (BoostedTrees, GBTClassifier))
    assert isinstance(own, GBTClassificationModel) and own.getNumTrees == 6 and own.treeWeights == other.treeWeights and own.numFeatures == 12
    found, wanted = scores(own, rows), scores(other, rows)
    assert max(abs(found[k] - wanted[k]) for k in wanted) < 1e-9 and len({round(v, 6) for v in found.values()}) > 20
    assert np.allclose(own.featureImportances.toArray(), other.featureImportances.toArray())


def test_no_job_a_level(spark, rows):
    """A fit ran a job for each level of each tree, 4 x 30 here, however few its rows."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "fit")
    try:
        learner(BoostedTrees, maxIter=30).fit(rows)
        assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 30
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_more_rows_than_fit_a_task_are_left_to_spark_ml(rows, monkeypatch):
    few = scores(learner(BoostedTrees).fit(rows), rows)
    monkeypatch.setattr(boosting, "MOST_BYTES", 1000)
    monkeypatch.setattr(BoostedTrees, "_model", lambda *_: pytest.fail("grown in one task"))
    many = scores(learner(BoostedTrees).fit(rows), rows)
    assert max(abs(few[k] - many[k]) for k in few) < 1e-9


def test_draws_and_least_rows(rows):
    model = learner(BoostedTrees, maxIter=4, subsamplingRate=0.6, featureSubsetStrategy="0.5", minInstancesPerNode=20).fit(rows)
    path = scratch_path(rows.sparkSession, "model")
    model.write().save(path)
    nodes = rows.sparkSession.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    assert nodes.agg(F.min("rawCount")).first()[0] >= 20
    drawn = [r.rawCount for r in nodes.filter("id = 0").orderBy("treeID").collect()]
    assert len(drawn) == 4 and len(set(drawn)) > 1 and all(450 < n < 630 for n in drawn)
    again = learner(BoostedTrees, maxIter=4, subsamplingRate=0.6, featureSubsetStrategy="0.5", minInstancesPerNode=20).fit(rows)
    assert scores(model, rows) == scores(again, rows) == scores(GBTClassificationModel.load(path), rows)


def test_one_class_and_constant_columns(spark, rows):
    one = rows.filter("target = 0")
    assert learner(BoostedTrees).fit(one).totalNumNodes == 6
    constant = spark.createDataFrame([(float(n % 2), 1.0, Vectors.dense([4.0])) for n in range(30)], ["target", "w", "features"])
    model = learner(BoostedTrees).fit(constant)
    assert model.totalNumNodes == 6 and {round(float(p[0][1]), 9) for p in model.transform(constant).select("probability").collect()} == {0.5}


def test_shared_codes_keep_every_column(rows, monkeypatch):
    """Codes of few and of many columns give the same sums."""
    monkeypatch.setattr(boosting, "FEW_VALUES", 4)
    apart = scores(learner(BoostedTrees).fit(rows), rows)
    monkeypatch.setattr(boosting, "FEW_VALUES", 4096)
    monkeypatch.setattr(boosting, "ROWS_AT_ONCE", 64)
    monkeypatch.setattr(boosting, "DENSE_SHARE", 0.0)
    packed = scores(learner(BoostedTrees).fit(rows), rows)
    assert max(abs(apart[k] - packed[k]) for k in apart) < 1e-9


def test_training_uses_it(rows):
    assert isinstance(training._boosted({}), BoostedTrees)


def jobs_of(spark, work):
    """How many Spark jobs `work` runs, its threads' included."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_trial_of_the_search_runs_no_job_a_level(spark, rows):
    vectors = rows.select(F.col("target").cast("int").alias(training.LABEL), "features")
    params = {"trees": 30, "depth": 4, "subsample": 0.8, "feature_share": 0.7, "positive_weight": 3.0, "min_rows": 2}
    assert 0 < jobs_of(spark, lambda: training._fit_vectors(vectors, params)) < 30


def test_feature_sets_run_no_job_a_level(spark, fact):
    sets = {"raw": training.ft.FEATURE_SETS["raw_2_no_personal_ids"], "cell": training.ft.FEATURE_SETS["cell_1_all_columns"]}
    assert 0 < jobs_of(spark, lambda: training.sweep(fact, sets, trees=25, depth=4)) < 2 * 25 * 4
