"""Classification quality, latency and run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cardwatch import functions as fn
from cardwatch.operators.ordered import exact_percentiles, running_totals


def confusion_matrix(df: DataFrame, label: str = "is_fraud", predicted: str = "prediction") -> DataFrame:
    """tn, fp, fn, tp over rows that have a prediction."""

    def cell(actual: int, said: int) -> Column:
        return F.count(F.when((F.col(label) == actual) & (F.col(predicted) == said), 1))

    return df.filter(F.col(predicted).isNotNull()).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    square = beta * beta
    return _share((1 + square) * precision * recall, square * precision + recall)


def classification_metrics(matrix: DataFrame) -> DataFrame:
    """Accuracy, class-1 and macro figures of rows that hold tn, fp, fn, tp; 0/0 is 0."""
    tn, fp, fn_, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall = _share(tp, tp + fp), _share(tp, tp + fn_)
    precision0, recall0 = _share(tn, tn + fn_), _share(tn, tn + fp)
    f1, f1_of_0 = f_beta(precision, recall, 1.0), f_beta(precision0, recall0, 1.0)
    return matrix.withColumns(
        {
            "accuracy": _share(tp + tn, tn + fp + fn_ + tp),
            "prec_class_1": precision,
            "rec_class_1": recall,
            "f1_class_1": f1,
            "f2_class_1": f_beta(precision, recall, 2.0),
            "F1_global": (f1 + f1_of_0) / 2.0,
            "recall_global": (recall + recall0) / 2.0,
        }
    )


def roc_auc(df: DataFrame, label: str = "is_fraud", score: str = "prediction_proba") -> DataFrame:
    """Exact area under the ROC curve from rank sums over the distinct scores."""
    hist = (
        df.filter(F.col(label).isin(0, 1) & F.col(score).isNotNull())
        .groupBy(F.col(score).alias("score"))
        .agg(
            F.count(F.when(F.col(label) == 1, 1)).alias("ones"),
            F.count(F.when(F.col(label) == 0, 1)).alias("zeros"),
        )
    )
    ranked = running_totals(hist, "score", ["ones", "zeros"])
    # a one beats every zero scored lower and half of those scored the same
    wins = F.col("ones").cast("decimal(19,0)") * (2 * F.col("cum_zeros") - F.col("zeros")).cast("decimal(18,0)")
    return ranked.agg(
        F.try_divide(
            F.sum(wins).cast("double"), 2.0 * F.max("total_ones").cast("double") * F.max("total_zeros").cast("double")
        ).alias("roc_auc")
    )


def latency_summary(df: DataFrame, column: str = "prediction_latency_ms") -> DataFrame:
    """Mean, median, min, max, p95, p99 and population deviation."""
    shape = df.select(F.col(column).cast("double").alias("v")).agg(
        F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.stddev_pop("v").alias("std")
    )
    places = exact_percentiles(df, column, {"median": 0.5, "p95": 0.95, "p99": 0.99})
    of = {c: shape.select(c).scalar() for c in shape.columns}
    return places.select(
        of["mean"].alias("mean"),
        "median",
        of["min"].alias("min"),
        of["max"].alias("max"),
        "p95",
        "p99",
        of["std"].alias("std"),
    )


# Where each summary figure is looked up, first hit wins.
METRIC_NAMES = {
    "F1_global": ["F1_global", "f1_global", "f1_score"],
    "recall_global": ["recall_global", "recall"],
    "f1_class_1": ["f1_class_1", "f1_score"],
    "rec_class_1": ["rec_class_1", "recall_class_1", "recall"],
    "prec_class_1": ["prec_class_1", "precision_class_1", "precision"],
    "f2_class_1": ["f2_class_1", "f2_score"],
}


def best_run(runs: DataFrame) -> DataFrame:
    """The run with the highest class-1 F2 per experiment, earliest start on ties, with a summary line."""

    def first_of(name: str) -> Column:
        value = F.lit(0.0)
        for source in reversed(METRIC_NAMES[name]):
            value = fn.map_get(F.col("metrics"), source, value)
        return value

    figures = runs.withColumns({name: first_of(name) for name in METRIC_NAMES})
    order = Window.partitionBy("experiment").orderBy(F.col("f2_class_1").desc(), "start_time", "run_id")
    best = figures.withColumn("_row", F.row_number().over(order)).filter("_row = 1")
    name = F.coalesce("run_name", F.substring("run_id", 1, 8))
    parts = [F.format_string(f"{label}: %.4f", F.col(label)) for label in METRIC_NAMES]
    return best.select(
        "experiment",
        "run_id",
        name.alias("run_name"),
        *METRIC_NAMES,
        F.concat_ws(" | ", F.concat(F.lit("best run: "), name), *parts).alias("summary"),
    )


def leaderboard(runs: DataFrame, champion: str | None = None) -> DataFrame:
    """Runs with class-1 precision, their F2 and the sampling ratio as text; champion flagged."""
    scored = runs.filter(F.map_contains_key("metrics", "prec_class_1"))
    precision = F.col("metrics")["prec_class_1"]
    recall = fn.map_get(F.col("metrics"), "rec_class_1", 0.0)

    def optional(name: str) -> Column:
        return fn.map_get(F.col("metrics"), name, 0.0).alias(name)

    return scored.select(
        "run_id",
        "run_name",
        fn.run_model_type(F.col("run_name")).alias("model_type"),
        fn.run_ratio(F.col("run_name")).alias("ratio"),
        recall.alias("rec_class_1"),
        precision.alias("prec_class_1"),
        optional("f1_class_1"),
        f_beta(precision, recall, 2.0).alias("f2_class_1"),
        optional("F1_global"),
        optional("recall_global"),
        F.col("run_id").eqNullSafe(F.lit(champion).cast("string")).alias("is_champion"),
    )


def champion_run(runs: DataFrame, flag: str = "champion") -> DataFrame:
    """The flagged run, else the newest; no row when there are no runs."""
    flagged = F.coalesce(F.col(flag), F.lit(False))
    return runs.orderBy(flagged.desc(), F.col("start_time").desc(), "run_id").limit(1)
