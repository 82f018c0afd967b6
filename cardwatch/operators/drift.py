"""Distance and test statistics between a reference and a current window."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.functions.tails import chi_square_tail, kolmogorov_tail, normal_tail
from cardwatch.operators.filters import TS
from cardwatch.operators.ordered import running_totals
from cardwatch.session import durable

# Windows in days, alarm thresholds, smallest testable window.
REFERENCE_DAYS, CURRENT_DAYS = 30, 1
DISTANCE_THRESHOLD, P_VALUE_THRESHOLD = 0.1, 0.05
DRIFT_SHARE = 0.5
MIN_CURRENT_ROWS = 20
SMALLEST_SPREAD = 0.001
NUMERIC = ["amt", "hour_sin", "hour_cos", "distance_achat"]
CATEGORICAL = ["gender", "is_fraud"]
WASSERSTEIN, JENSEN_SHANNON = "Wasserstein distance (normed)", "Jensen-Shannon distance"


def drift_windows(df: DataFrame, day: str, ts: str = TS) -> DataFrame:
    """Rows of [day-31, day-1) tagged `reference` and of [day-1, day) tagged `current`.

    One scan with literal bounds: both pushed down and pruned by date partitions.
    """
    end = F.lit(day).cast("timestamp_ntz")
    split = end - F.expr(f"INTERVAL {CURRENT_DAYS} DAYS")
    start = split - F.expr(f"INTERVAL {REFERENCE_DAYS} DAYS")
    inside = df.filter((F.col(ts) >= start) & (F.col(ts) < end))
    return inside.withColumn("part", F.when(F.col(ts) < split, F.lit("reference")).otherwise(F.lit("current")))


def _value_counts(tagged: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """Rows per (column, value) in each window; NULL values are left out."""
    long = tagged.select("part", *[F.col(c).cast(kind).alias(c) for c in columns]).unpivot(
        ["part"], list(columns), "column_name", "value"
    )
    return (
        long.filter(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(
            F.count(F.when(F.col("part") == "reference", 1)).alias("ref"),
            F.count(F.when(F.col("part") == "current", 1)).alias("cur"),
        )
    )


def _cdf_gaps(tagged: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both distribution functions at every distinct value, with the step to the next."""
    ranked = running_totals(_value_counts(tagged, columns, "double"), "value", ["ref", "cur"], ["column_name"])
    gap = F.abs(
        F.try_divide(F.col("cum_ref").cast("double"), F.col("total_ref").cast("double"))
        - F.try_divide(F.col("cum_cur").cast("double"), F.col("total_cur").cast("double"))
    )
    return ranked.withColumn("gap", gap).withColumn("step", F.col("next_value") - F.col("value"))


def wasserstein(tagged: DataFrame, columns: Sequence[str] = NUMERIC) -> DataFrame:
    """Area between the two distribution functions over the reference deviation, per column."""
    area = _cdf_gaps(tagged, columns).groupBy("column_name").agg(F.sum(F.col("gap") * F.col("step")).alias("area"))
    spread = (
        tagged.filter(F.col("part") == "reference")
        .agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in columns])
        .unpivot([], list(columns), "column_name", "spread")
    )
    return area.join(F.broadcast(spread), "column_name").select(
        "column_name",
        (F.coalesce("area", F.lit(0.0)) / F.greatest("spread", F.lit(SMALLEST_SPREAD))).alias("metric_value"),
        F.lit(DISTANCE_THRESHOLD).alias("threshold"),
        F.lit(WASSERSTEIN).alias("method"),
    )


def js_distance(tagged: DataFrame, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """Square root of the Jensen-Shannon divergence of the value shares, per column."""
    counts = _value_counts(tagged, columns, "string")
    totals = counts.groupBy("column_name").agg(F.sum("ref").alias("all_ref"), F.sum("cur").alias("all_cur"))
    shares = counts.join(F.broadcast(totals), "column_name").select(
        "column_name",
        F.try_divide(F.col("ref").cast("double"), F.col("all_ref").cast("double")).alias("p"),
        F.try_divide(F.col("cur").cast("double"), F.col("all_cur").cast("double")).alias("q"),
    )
    middle = (F.col("p") + F.col("q")) / 2.0

    def towards_middle(share: str):
        return F.when(F.col(share) > 0, F.col(share) * F.ln(F.col(share) / middle)).otherwise(0.0)

    divergence = F.sum(towards_middle("p") + towards_middle("q")) / 2.0
    return shares.groupBy("column_name").agg(
        F.sqrt(F.when(divergence > 0, divergence).otherwise(0.0)).alias("metric_value"),
        F.lit(DISTANCE_THRESHOLD).alias("threshold"),
        F.lit(JENSEN_SHANNON).alias("method"),
    )


def drift_flags(statistics: DataFrame) -> DataFrame:
    """Distances alarm above their threshold, p-values below it."""
    is_distance = F.contains(F.lower("method"), F.lit("distance"))
    alarmed = F.when(is_distance, F.col("metric_value") > F.col("threshold")).otherwise(
        F.col("metric_value") < F.col("threshold")
    )
    return statistics.withColumn("drift_detected", F.coalesce(alarmed, F.lit(False)))


def column_drift(tagged: DataFrame, numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL) -> DataFrame:
    statistics = [f(tagged, names) for f, names in ((wasserstein, numeric), (js_distance, categorical)) if names]
    return drift_flags(reduce(DataFrame.unionByName, statistics))


def drift_report(
    df: DataFrame, day: str, numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL
) -> tuple[DataFrame, DataFrame]:
    """(one-row verdict, one row per column).

    More than half of the columns must drift; fewer than 20 current rows are not
    testable and count as no drift.
    """
    # several statistics read these few columns; the wide source is read once
    tagged = durable(drift_windows(df, day).select("part", *numeric, *categorical), "drift-windows")
    details = column_drift(tagged, numeric, categorical)
    rows = tagged.agg(F.count(F.when(F.col("part") == "current", 1)).alias("n")).scalar()
    verdict = (
        details.agg(F.avg(F.col("drift_detected").cast("int")).alias("mean_drift_ratio"))
        .select(
            F.lit(day).alias("current_date"),
            rows.alias("sample_size"),
            (rows >= MIN_CURRENT_ROWS).alias("testable"),
            F.coalesce("mean_drift_ratio", F.lit(0.0)).alias("mean_drift_ratio"),
        )
        .withColumn("drift_detected", F.col("testable") & (F.col("mean_drift_ratio") > DRIFT_SHARE))
    )
    return verdict, details


def needs_retrain(verdict: DataFrame) -> DataFrame:
    """Retrain on drift.  A window without any row is an error, not a quiet 'no'."""
    empty = F.raise_error(F.lit("the current window holds no rows")).cast("boolean")
    return verdict.select(
        "current_date", F.when(F.col("sample_size") == 0, empty).otherwise(F.col("drift_detected")).alias("retrain")
    )


def small_sample_statistics(tagged: DataFrame, numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL) -> DataFrame:
    """Test statistics used when the reference has at most 1000 rows: the largest
    Kolmogorov-Smirnov gap for numbers, chi-square for classes, z for two classes."""
    largest = _cdf_gaps(tagged, numeric).groupBy("column_name").agg(
        F.max("gap").alias("statistic"),
        F.max("total_ref").cast("double").alias("n_ref"),
        F.max("total_cur").cast("double").alias("n_cur"),
        F.lit(0).alias("freedom"),
        F.lit("K-S p_value").alias("method"),
    )
    counts = _value_counts(tagged, categorical, "string")
    totals = counts.groupBy("column_name").agg(
        F.sum("ref").cast("double").alias("n_ref"),
        F.sum("cur").cast("double").alias("n_cur"),
        F.count(F.lit(1)).alias("classes"),
        F.max_by("ref", "value").cast("double").alias("top_ref"),
        F.max_by("cur", "value").cast("double").alias("top_cur"),
    )
    expected = F.try_divide(F.col("ref"), F.col("n_ref")) * F.col("n_cur")
    chi = (
        counts.join(F.broadcast(totals), "column_name")
        .groupBy("column_name")
        .agg(F.sum(F.when(expected > 0, F.pow(F.col("cur") - expected, F.lit(2.0)) / expected)).alias("chi"))
    )
    pooled = F.try_divide(F.col("top_ref") + F.col("top_cur"), F.col("n_ref") + F.col("n_cur"))
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("n_ref")) + F.try_divide(F.lit(1.0), F.col("n_cur"))))
    gap = F.try_divide(F.col("top_ref"), F.col("n_ref")) - F.try_divide(F.col("top_cur"), F.col("n_cur"))
    z = F.coalesce(F.try_divide(gap, error), F.lit(0.0))
    classes = totals.join(chi, "column_name").select(
        "column_name",
        F.when(F.col("classes") > 2, F.coalesce("chi", F.lit(0.0))).otherwise(z).alias("statistic"),
        "n_ref",
        "n_cur",
        F.greatest(F.col("classes") - 1, F.lit(1)).cast("int").alias("freedom"),
        F.when(F.col("classes") > 2, F.lit("chi-square p_value")).otherwise(F.lit("Z-test p_value")).alias("method"),
    )
    return largest.unionByName(classes)


def p_value(method: Column, statistic: Column, n_ref: Column, n_cur: Column, freedom: Column) -> Column:
    """The p-value of a test statistic; null for an unknown method or a missing statistic."""
    return (
        F.when(method == "K-S p_value", kolmogorov_tail(statistic, n_ref, n_cur))
        .when(method == "chi-square p_value", chi_square_tail(statistic, freedom))
        .when(method == "Z-test p_value", normal_tail(statistic))
    )


def small_sample_tests(tagged: DataFrame, numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL) -> DataFrame:
    """The statistics as p-values, summed as column expressions."""
    statistics = small_sample_statistics(tagged, numeric, categorical)
    value = p_value(*[F.col(c) for c in ("method", "statistic", "n_ref", "n_cur", "freedom")])
    return statistics.select("column_name", value.alias("metric_value"), "method", F.lit(P_VALUE_THRESHOLD).alias("threshold"))


def drift_head_tail(tagged: DataFrame, numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL) -> DataFrame:
    """Scores and flags of tagged first/last rows, with the share-of-columns verdict.

    A side without rows is no drift: its Kolmogorov-Smirnov p-value is null, its z is 0.
    """
    flagged = durable(drift_flags(small_sample_tests(tagged, numeric, categorical)), "tests")
    share = flagged.agg(F.avg(F.col("drift_detected").cast("int")).alias("share")).scalar()
    return flagged.withColumn("dataset_drift", share >= DRIFT_SHARE)
