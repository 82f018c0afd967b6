"""Training, scoring and comparison of classifiers with Spark ML."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cardwatch import functions as fn
from cardwatch.operators import features as ft
from cardwatch.operators.filters import first_days, outlier_filter
from cardwatch.operators.history import neighbour_mean, share_name
from cardwatch.operators.metrics import classification_metrics, confusion_matrix, roc_auc
from cardwatch.operators.sampling import (
    KEY,
    class_count,
    oversample,
    rebalance,
    stratified_folds,
    stratified_split,
    undersample,
)
from cardwatch.plans.boosting import BoostedTrees
from cardwatch.session import durable, scratch_path

LABEL, WEIGHT = "is_fraud", "row_weight"
INDEXED_TEXT = ["category", "gender"]
HASH_WIDTH = 1 << 10
# An indexed text column has at most so many values; each becomes a column of its own.
MOST_CLASSES = 1000
# Trees, depth and learning rate every comparison uses.
TREES, DEPTH, RATE = 100, 6, 0.1


def model_input(name: str) -> Column:
    """A column as the type the vectoriser takes: text, or a number (a date counts days).
    What is missing becomes `unknown` or 0."""
    if name in INDEXED_TEXT or name in ft.UNBOUNDED_TEXT:
        return F.coalesce(F.col(name).cast("string"), F.lit("unknown")).alias(name)
    number = F.unix_date(F.col(name)) if name == "dob" else F.col(name)
    return F.coalesce(number.cast("double"), F.lit(0.0)).alias(name)


def vectorizer(columns: Sequence[str], output: str = "features") -> list:
    """Numbers pass through, short category lists are one-hot, unbounded text is hashed.

    A string index collects its labels on the driver, so only columns with a fixed
    small set of values get one.
    """
    indexed = [c for c in columns if c in INDEXED_TEXT]
    hashed = [c for c in columns if c in ft.UNBOUNDED_TEXT]
    numbers = [c for c in columns if c not in indexed and c not in hashed]
    stages, inputs = [], list(numbers)
    if indexed:
        stages.append(StringIndexer(inputCols=indexed, outputCols=[f"{c}_index" for c in indexed], handleInvalid="keep"))
        stages.append(
            OneHotEncoder(
                inputCols=[f"{c}_index" for c in indexed],
                outputCols=[f"{c}_onehot" for c in indexed],
                dropLast=False,
            )
        )
        inputs += [f"{c}_onehot" for c in indexed]
    if hashed:
        stages.append(FeatureHasher(inputCols=hashed, outputCol="hashed_text", numFeatures=HASH_WIDTH))
        inputs.append("hashed_text")
    return stages + [VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="error")]


def class_weights(df: DataFrame, balanced: bool = False, positive_weight: float = 1.0) -> DataFrame:
    """Add the row weight: n / (2 n_class) when balanced, else `positive_weight` for class 1."""
    if not balanced:
        return df.withColumn(WEIGHT, F.when(F.col(LABEL) == 1, F.lit(float(positive_weight))).otherwise(F.lit(1.0)))
    ones, zeros = class_count(df, 1), class_count(df, 0)
    own = F.when(F.col(LABEL) == 1, ones).otherwise(zeros)
    return df.withColumn(WEIGHT, (ones + zeros) / (F.lit(2.0) * own))


@dataclass(frozen=True)
class Model:
    """A fitted pipeline and the columns it reads."""

    pipeline: PipelineModel
    columns: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(df)

    def save(self, spark: SparkSession, path: str) -> None:
        """Under `path`: the pipeline, and the columns it reads."""
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark.createDataFrame([(list(self.columns),)], "columns array<string>").write.mode("overwrite").parquet(f"{path}/columns")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        """The model that `save` wrote, also in another application."""
        return cls(PipelineModel.load(f"{path}/pipeline"), list(spark.read.parquet(f"{path}/columns").first()["columns"]))


def _tree_folder(spark: SparkSession) -> None:
    """Boosted trees cut their lineage in a shared folder."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(scratch_path(spark, "trees"))


def _used_hashes(stages: list, rows: DataFrame) -> list:
    """The stages with the hashed text cut to the places that occur in `rows`.

    A place that is 0 in every row has no split, so trees that look at all columns come out the same; a place costs
    them 4 bytes and a step a row and level, whether it occurs or not.  One row of HASH_WIDTH counts reaches the driver.
    """
    at = next((n for n, stage in enumerate(stages) if isinstance(stage, FeatureHasher)), None)
    if at is None:
        return stages
    counts = stages[at].transform(rows).select(Summarizer.numNonZeros(F.col("hashed_text"))).first()[0]
    used = [place for place, n in enumerate(counts.toArray() if counts is not None else []) if n]
    if len(used) in (0, HASH_WIDTH):
        return stages
    assembler = stages[-1].copy({stages[-1].inputCols: [f"{c}_used" if c == "hashed_text" else c for c in stages[-1].getInputCols()]})
    slicer = VectorSlicer(inputCol="hashed_text", outputCol="hashed_text_used", indices=used)
    return [*stages[: at + 1], slicer, *stages[at + 1 : -1], assembler]


# Rows that a task of a boosted tree reads, from and to: it runs a job a level, so few tasks are wanted, but none much longer than the others.
ROWS_PER_TASK, MOST_ROWS_PER_TASK = 50_000, 1_000_000
# Rows are dealt anew where the largest task has more than so many times the even share of a core, or the most rows of a task.
UNEVEN = 1.5


def tree_tasks(rows: int, cores: int) -> int:
    """Tasks for a boosted tree: one for each ROWS_PER_TASK rows up to one a core, then as many on every core as MOST_ROWS_PER_TASK asks for.

    >>> [tree_tasks(rows, 12) for rows in (0, 60_000, 4_200_000, 25_200_000)]
    [1, 2, 12, 36]
    """
    rounds = -(-rows // (MOST_ROWS_PER_TASK * cores))
    return max(1, min(-(-rows // ROWS_PER_TASK), rounds * cores))


def _evenly(df: DataFrame) -> DataFrame:
    """The rows as a boosted tree should read them: as they are if their largest task is near the even share, else dealt
    to tasks of equal numbers of rows and stored.

    A level of a tree takes as long as its largest task, and a small table lies in few files of any size.
    """
    sizes = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
    rows, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = tree_tasks(rows, cores)
    if largest * min(tasks, cores) <= UNEVEN * rows and largest <= UNEVEN * MOST_ROWS_PER_TASK:
        return df
    return durable(df.repartition(tasks), "even")


def _fit(df: DataFrame, columns: Sequence[str], learner, scaled: bool = False, used_hashes: bool = False, **weighting) -> Model:
    rows = class_weights(df, **weighting).select(
        F.col(LABEL).alias("target"), WEIGHT, *[model_input(c) for c in columns]
    )
    if isinstance(learner, GBTClassifier):
        rows = _evenly(rows)
    stages = vectorizer(columns, "raw_features" if scaled else "features")
    if used_hashes:
        stages = _used_hashes(stages, rows)
    if scaled:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    _tree_folder(df.sparkSession)
    return Model(Pipeline(stages=[*stages, learner]).fit(rows), list(columns))


def train_gbt(
    df: DataFrame,
    columns: Sequence[str] = ft.MODEL_FEATURES,
    trees: int = TREES,
    depth: int = DEPTH,
    rate: float = RATE,
    balanced: bool = False,
    positive_weight: float = 1.0,
    subsample: float = 1.0,
    feature_share: float = 1.0,
    min_rows: int = 1,
    seed: int = 42,
) -> Model:
    """Boosted trees; class weights stand in for a positive-class scale."""
    learner = BoostedTrees(
        labelCol="target",
        weightCol=WEIGHT,
        maxIter=trees,
        maxDepth=depth,
        stepSize=rate,
        subsamplingRate=subsample,
        featureSubsetStrategy=str(feature_share) if feature_share < 1.0 else "all",
        minInstancesPerNode=min_rows,
        seed=seed,
        checkpointInterval=10,
    )
    # with a share of the columns drawn for each node, how many there are decides which are drawn
    return _fit(df, columns, learner, used_hashes=feature_share >= 1.0, balanced=balanced, positive_weight=positive_weight)


def train_lr(df: DataFrame, columns: Sequence[str] = ft.MODEL_FEATURES, iterations: int = 100, balanced: bool = False) -> Model:
    """Logistic regression on standardised features."""
    learner = LogisticRegression(labelCol="target", weightCol=WEIGHT, maxIter=iterations, standardization=False)
    return _fit(df, columns, learner, scaled=True, balanced=balanced)


def train_rf(df: DataFrame, columns: Sequence[str] = ft.MODEL_FEATURES, trees: int = TREES, depth: int = DEPTH, seed: int = 42) -> Model:
    learner = RandomForestClassifier(labelCol="target", weightCol=WEIGHT, numTrees=trees, maxDepth=depth, seed=seed)
    return _fit(df, columns, learner)


def class_values(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """The values of indexed text columns, sorted; `unknown` for a missing one.

    One pass whatever the number of columns.  More than MOST_CLASSES values is an error: such a column has to be hashed.
    """
    if not columns:
        return {}
    long = df.select(*[model_input(c) for c in columns]).unpivot([], list(columns), "column_name", "value").distinct()
    found: dict[str, list[str]] = {c: [] for c in columns}
    for row in long.limit(MOST_CLASSES * len(columns) + 1).collect():
        found[row["column_name"]].append(row["value"])
    for c, values in found.items():
        if len(values) > MOST_CLASSES:
            raise ValueError(f"{c} has more than {MOST_CLASSES} values")
    return {c: sorted(values) for c, values in found.items()}


def with_neighbourhood(df: DataFrame, columns: Sequence[str] = ft.MODEL_FEATURES_NO_CITY) -> tuple[DataFrame, list[str]]:
    """(rows with the same-card means of the encoded features, the names of those means).

    Numbers give their mean, indexed text the share of each of its values; hashed text is left out.
    """
    indexed = [c for c in columns if c in INDEXED_TEXT]
    numbers = [c for c in columns if c not in indexed and c not in ft.UNBOUNDED_TEXT]
    classes = class_values(df, indexed)
    names = [f"nb_{c}" for c in numbers] + [share_name(c, v) for c, values in classes.items() for v in values]
    return neighbour_mean(df, numbers, classes=classes), names


def train_graph_lr(df: DataFrame, columns: Sequence[str] | None = None, iterations: int = 100) -> Model:
    """Two propagation steps over the same-card graph, then a linear classifier.

    Averaging twice over one card equals averaging once: the card mean is constant
    within the card.  `df` must already carry the means of `with_neighbourhood`;
    `columns` are those that are used, all of them by default.
    """
    return train_lr(df, list(columns) if columns else [c for c in df.columns if c.startswith("nb_")], iterations)


def train_graph_gbt(df: DataFrame, columns: Sequence[str] = ft.MODEL_FEATURES_NO_CITY, **params) -> Model:
    """Boosted trees on own features next to the same-card means."""
    means = [c for c in df.columns if c.startswith("nb_")]
    return train_gbt(df, [*columns, *means], **params)


def score(df: DataFrame, model: Model, version: int = 1) -> DataFrame:
    """Add class, probability of class 1 and the model version; other columns stay."""
    kept = [c for c in df.columns if c not in ("prediction", "prediction_proba", "model_version")]
    inputs = df.select(F.struct(*kept).alias("kept"), *[model_input(c) for c in model.columns])
    return model.transform(inputs).select(
        "kept.*",
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].cast("decimal(5,4)").alias("prediction_proba"),
        fn.version_label(version).alias("model_version"),
    )


def evaluate(df: DataFrame, model: Model, name: str) -> DataFrame:
    """One row of quality figures on held-out rows."""
    matrix = confusion_matrix(score(df, model), LABEL, "prediction")
    return classification_metrics(matrix).select(F.lit(name).alias("run_name"), "*")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _in_threads(spark: SparkSession, work: Callable, items: Sequence, parallelism: int) -> list:
    """Submit independent fits together so that their jobs share the cluster."""
    pool = ThreadPool(max(1, min(parallelism, len(items))))
    try:
        return pool.map(inheritable_thread_target(spark)(work), items, chunksize=1)
    finally:
        pool.close()


def sweep(
    df: DataFrame, sets: dict[str, Sequence[str]] | None = None, test_share: float = 0.3, parallelism: int = 4, **params
) -> DataFrame:
    """One boosted-tree model per feature set on the same split; a row of figures each."""
    sets = sets or ft.FEATURE_SETS
    prepared = ft.cells(ft.cartesian(outlier_filter(ft.engineered(df))))
    train, test = (durable(part, "split") for part in stratified_split(prepared, test_share))

    def one(name: str) -> DataFrame:
        return evaluate(test, train_gbt(train, sets[name], **params), name).withColumn(
            "num_features", F.lit(len(sets[name]))
        )

    return union_all(_in_threads(df.sparkSession, one, list(sets), parallelism))


def sampling_sweep(
    df: DataFrame, ratios: Sequence[float] = (0.05, 0.10), test_share: float = 0.3, parallelism: int = 4, **params
) -> DataFrame:
    """Four model kinds at each fraud ratio, and boosted trees on 1:1 under- and oversampling."""
    columns = ft.MODEL_FEATURES_NO_CITY
    graph, means = with_neighbourhood(outlier_filter(ft.engineered(df)), columns)
    train, test = (durable(part, "split") for part in stratified_split(graph, test_share))
    kinds: dict[str, Callable[[DataFrame], Model]] = {
        "BoostedTrees": lambda rows: train_gbt(rows, columns, **params),
        "BalancedTrees": lambda rows: train_gbt(rows, columns, balanced=True, **params),
        "GraphLinear": lambda rows: train_graph_lr(rows, means),
        "GraphTrees": lambda rows: train_graph_gbt(rows, columns, **params),
    }
    cases = [
        (f"{kind}_Sampling_{round(ratio * 100)}pc", fit, lambda rows, r=ratio: rebalance(rows, r))
        for ratio in ratios
        for kind, fit in kinds.items()
    ]
    cases += [("UnderSampling", kinds["BoostedTrees"], undersample), ("OverSampling", kinds["BoostedTrees"], oversample)]

    def one(case: tuple) -> DataFrame:
        name, fit, sample = case
        return evaluate(test, fit(sample(train)), name)

    return union_all(_in_threads(df.sparkSession, one, cases, parallelism))


def cross_validate(
    df: DataFrame,
    k: int = 5,
    fit: Callable[[DataFrame], Model] = train_gbt,
    sample: Callable[[DataFrame], DataFrame] | None = None,
    with_train: bool = True,
    parallelism: int = 4,
    with_auc: bool = True,
) -> DataFrame:
    """Precision, recall, F1, F2 and (optionally) AUC per fold, on held-out and (optionally) training rows.

    `sample` thins the training part only.  Rows that carry a `fold` from 0 to k - 1 keep it; others are dealt and stored.
    """
    folds = df if "fold" in df.columns else durable(stratified_folds(df, k), "folds")

    def one(fold: int) -> DataFrame:
        train, held = folds.filter(F.col("fold") != fold), folds.filter(F.col("fold") == fold)
        model = fit(sample(train) if sample else train)
        parts = {"held_out": held, **({"train": train} if with_train else {})}
        rows = []
        for part, data in parts.items():
            scored = durable(score(data, model).select(LABEL, "prediction", "prediction_proba"), "scored")
            auc = [roc_auc(scored).scalar().alias("roc_auc")] if with_auc else []
            figures = classification_metrics(confusion_matrix(scored))
            rows.append(figures.select(F.lit(fold).alias("fold"), F.lit(part).alias("part"), "*", *auc))
        return union_all(rows)

    return union_all(_in_threads(df.sparkSession, one, list(range(k)), parallelism))


# The search space of the boosted-tree tuning.
SEARCH_SPACE: dict[str, Callable[[random.Random], float]] = {
    "trees": lambda r: r.randrange(50, 301, 50),
    "depth": lambda r: r.randint(3, 10),
    "rate": lambda r: 10 ** r.uniform(-2.0, -0.69897),
    "positive_weight": lambda r: r.uniform(1.0, 100.0),
    "subsample": lambda r: r.uniform(0.6, 1.0),
    "feature_share": lambda r: r.uniform(0.6, 1.0),
    "min_rows": lambda r: r.randint(1, 10),
}


@dataclass(frozen=True)
class SearchResult:
    trials: DataFrame
    best: dict[str, float]
    model: Model
    figures: DataFrame


@dataclass(frozen=True)
class SearchRows:
    """What all trials of a search share: feature vectors of the training part with their folds, made once."""

    vectors: DataFrame
    train: DataFrame
    test: DataFrame
    encoder: PipelineModel
    columns: list[str]


def search_rows(df: DataFrame, columns: Sequence[str] = ft.MODEL_FEATURES, folds: int = 5, test_share: float = 0.2) -> SearchRows:
    """Split, dealt into folds and vectorised; every labelled row is in the test part or in one fold."""
    train, test = (durable(part, "split") for part in stratified_split(df, test_share))
    dealt = stratified_folds(train, folds)
    inputs = dealt.select(F.col(KEY), F.col(LABEL), "fold", *[model_input(c).alias(f"in_{c}") for c in columns])
    inputs = durable(inputs, "folds")
    named = inputs.select(KEY, LABEL, "fold", *[F.col(f"in_{c}").alias(c) for c in columns if c not in (KEY, LABEL)])
    encoder = Pipeline(stages=vectorizer(columns)).fit(named)
    return SearchRows(durable(encoder.transform(named).select(KEY, LABEL, "fold", "features"), "vectors"), train, test, encoder, list(columns))


def fit_tasks(rows: int, cores: int, fits: int) -> int:
    """Tasks of each of `fits` boosted trees that grow at once: all together two a core, as a fit waits for the driver between
    its levels; a task more costs each level its closure and its own table of sums.

    >>> [fit_tasks(384_000, 12, fits) for fits in (1, 5, 12, 20)], fit_tasks(10_000, 12, 1), fit_tasks(4_000_000, 12, 20)
    ([8, 5, 2, 2], 1, 4)
    """
    return max(1, -(-rows // MOST_ROWS_PER_TASK), min(-(-rows // ROWS_PER_TASK), -(-2 * cores // max(1, fits))))


def _boosted(params: dict[str, float], seed: int = 42) -> BoostedTrees:
    share = params.get("feature_share", 1.0)
    return BoostedTrees(
        labelCol="target", weightCol=WEIGHT, maxIter=int(params.get("trees", TREES)), maxDepth=int(params.get("depth", DEPTH)), stepSize=params.get("rate", RATE),
        subsamplingRate=params.get("subsample", 1.0), featureSubsetStrategy=str(share) if share < 1.0 else "all", minInstancesPerNode=int(params.get("min_rows", 1)),
        seed=seed, checkpointInterval=10,
    )


def _fit_vectors(vectors: DataFrame, params: dict[str, float]):
    rows = class_weights(vectors, positive_weight=params.get("positive_weight", 1.0)).select(F.col(LABEL).alias("target"), WEIGHT, "features")
    _tree_folder(vectors.sparkSession)
    return _boosted(params).fit(rows)


def rungs(n_trials: int, folds: int, goes_on: int = 4) -> list[tuple[int, list[int], float]]:
    """(trials that run, the folds they run, the share of their trees) a rung: one in four goes on, with twice the trees
    and on another fold, until those that are left run in full on all folds.

    >>> rungs(20, 5)
    [(20, [0], 0.25), (5, [1], 0.5), (2, [0, 1, 2, 3, 4], 1.0)]
    """
    sizes = [n_trials]
    while sizes[-1] > goes_on // 2:
        sizes.append(-(-sizes[-1] // goes_on))
    last = len(sizes) - 1
    return [(size, list(range(folds)) if n == last else [n % folds], 0.5 ** (last - n)) for n, size in enumerate(sizes)]


def search(
    df: DataFrame,
    n_trials: int = 20,
    space: dict[str, Callable[[random.Random], float]] = SEARCH_SPACE,
    ratio: float = 0.05,
    folds: int = 5,
    test_share: float = 0.2,
    columns: Sequence[str] = ft.MODEL_FEATURES,
    seed: int = 42,
    parallelism: int = 12,
) -> SearchResult:
    """Random search for the highest mean class-1 F2 over stratified folds, by successive halving.

    All trials run on one fold with a part of their trees, the best on the next with more, until the rest has run on
    all folds with all trees (`rungs`); a trial's figures are those of the last rung it reached, and the winner is one of
    the last.  Only training folds are rebalanced, each once for all trials.  The best draw is refitted on the whole rebalanced training part and measured on rows no trial has seen.
    Where two trials are left, both are refitted beside their folds, so that the refit does not run alone at the end.
    One pair of numbers per trial and fold comes to the driver.
    """
    shared = search_rows(df, columns, folds, test_share)
    draw = random.Random(seed)
    trials = [{name: pick(draw) for name, pick in space.items()} for _ in range(n_trials)]
    figures: list[list[tuple[float, float]]] = [[] for _ in trials]
    running, reached, parts, cores = list(range(n_trials)), [0] * n_trials, {}, df.sparkSession.sparkContext.defaultParallelism

    def prepare(fold: int | None) -> tuple[DataFrame, int, DataFrame | None]:
        """(rows to fit, their number, rows held out); without a fold the whole training part, and none held out."""
        kept = shared.vectors if fold is None else shared.vectors.filter(F.col("fold") != fold)
        train = durable(rebalance(kept, ratio), "train-all" if fold is None else "train-fold")
        return train, train.count(), None if fold is None else shared.vectors.filter(F.col("fold") == fold)

    plan = rungs(n_trials, folds)
    for rung, (size, numbers, share) in enumerate(plan):
        running = sorted(running, key=lambda t: -_mean(figures[t], 0))[:size]
        ends = [None] if rung == len(plan) - 1 else []
        new = [fold for fold in [*numbers, *ends] if fold not in parts]
        parts.update(zip(new, _in_threads(df.sparkSession, prepare, new, parallelism)))
        cases = [(trial, fold) for trial in running for fold in [*numbers, *(ends if len(running) > 1 else [])]]
        at_once = min(parallelism, len(cases))

        def one(case: tuple[int, int | None], share: float = share, at_once: int = at_once):
            (train, rows, held), params = parts[case[1]], trials[case[0]]
            train = train.coalesce(fit_tasks(rows, cores, at_once))
            fitted = _fit_vectors(train, {**params, "trees": max(1, round(share * params.get("trees", TREES)))})
            if held is None:
                return fitted
            scored = fitted.transform(held).select(LABEL, F.col("prediction").cast("int").alias("prediction"))
            row = classification_metrics(confusion_matrix(scored)).first()
            return row["f2_class_1"], row["f1_class_1"]

        # the longest fits first, so that no thread is left with one at the end
        cases.sort(key=lambda c: -trials[c[0]].get("trees", TREES) * trials[c[0]].get("depth", DEPTH))
        found = dict(zip(cases, _in_threads(df.sparkSession, one, cases, parallelism)))
        for trial in running:
            figures[trial], reached[trial] = [found[trial, fold] for fold in numbers], rung
    winner = max(running, key=lambda t: _mean(figures[t], 0))
    best, fitted = trials[winner], found[winner, None] if (winner, None) in found else one((winner, None), at_once=1)
    model = Model(PipelineModel([*shared.encoder.stages, fitted]), shared.columns)
    rows = [(t, reached[t], len(f), _mean(f, 0), _mean(f, 1), {k: float(v) for k, v in trials[t].items()}) for t, f in enumerate(figures)]
    found = df.sparkSession.createDataFrame(rows, "trial int, rung int, n_folds int, mean_f2_class_1 double, mean_f1_class_1 double, params map<string,double>")
    return SearchResult(found, best, model, evaluate(shared.test, model, "best_of_search"))


def _mean(figures: list[tuple[float, float]], which: int) -> float:
    return sum(f[which] or 0.0 for f in figures) / len(figures) if figures else 0.0


def train_initial(df: DataFrame, days: int = 30, ratio: float = 0.05, test_share: float = 0.2, **params) -> tuple[Model, DataFrame]:
    """The first model: first 30 days, outliers cut, 80/20 split, 5 % fraud in training."""
    rows = durable(outlier_filter(ft.engineered(first_days(df, days, inclusive=True))), "initial")
    train, test = stratified_split(rows, test_share)
    model = train_gbt(rebalance(train, ratio), ft.MODEL_FEATURES, **params)
    return model, evaluate(test, model, "initial")
