"""Attributions of a linear model and what is read off them."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.operators.features import UNBOUNDED_TEXT
from cardwatch.operators.rules import attribution_rows
from cardwatch.plans.training import INDEXED_TEXT, Model, model_input

# The attributions stored with a transaction, the grouped names.
REPORTED = ["amt", "distance_achat", "age", "city_pop", "hour_sin", "hour_cos"]
GROUPS = {"hour": "Hour", "weekday": "Weekday", "month": "Month"}


class Weight(NamedTuple):
    coefficient: float
    mean: float
    scale: float = 1.0


def linear_weights(model: Model) -> dict[str, Weight]:
    """Coefficient, mean and scale per encoded column of a fitted logistic regression.

    Hashed text shares its coefficients among values and cannot be attributed: a model with such a column is an error.
    """
    hashed = [c for c in model.columns if c in UNBOUNDED_TEXT]
    if hashed:
        raise ValueError(f"hashed columns have no attributions: {', '.join(hashed)}")
    stages = model.pipeline.stages
    scaler, linear = stages[-2], stages[-1]
    names = [c for c in model.columns if c not in INDEXED_TEXT]
    labels = next((s.labelsArray for s in stages if hasattr(s, "labelsArray")), [])
    for column, values in zip([c for c in model.columns if c in INDEXED_TEXT], labels):
        # the index keeps a place for unknown values after the known ones
        names += [f"{column}_{v}" for v in values] + [f"{column}_unknown_value"]
    return {
        name: Weight(float(linear.coefficients[i]), float(scaler.mean[i]), float(scaler.std[i]) or 1.0)
        for i, name in enumerate(names)
    }


def encoded_value(name: str) -> Column:
    """The model input behind an encoded column name; what is missing counts as the model saw it."""
    for column in INDEXED_TEXT:
        if name.startswith(f"{column}_"):
            return (model_input(column) == name.removeprefix(f"{column}_")).cast("double")
    return model_input(name)


def contribution(name: str, weight: Weight) -> Column:
    """Exact share of the linear score: coefficient times standardised distance from the mean."""
    return (encoded_value(name) - F.lit(weight.mean)) * F.lit(weight.coefficient / weight.scale)


def attribute(scored: DataFrame, weights: Mapping[str, Weight]) -> DataFrame:
    """Store six attributions with predicted or suspected rows, NULL with all others.

    A reported feature the model does not use counts 0.0.
    """
    pairs: list[Column] = []
    for name in REPORTED:
        pairs += [F.lit(name), contribution(name, weights[name]) if name in weights else F.lit(0.0)]
    suspicious = (F.col("prediction") == 1) | (F.col("fast_pass_suspicion") == 1)
    return scored.withColumn("shap_values", F.when(suspicious, F.to_json(F.create_map(*pairs))))


def contribution_rows(df: DataFrame, weights: Mapping[str, Weight], key: str = "trans_num") -> DataFrame:
    """One row per encoded column, as `attribution_rows` has them."""
    return attribution_rows(df, key, {name: (encoded_value(name), contribution(name, weight)) for name, weight in weights.items()})


def _grouped_name() -> Column:
    part, wave = F.substring_index("feature", "_", 1), F.substring_index("feature", "_", -1)
    name = F.col("feature")
    for prefix, label in GROUPS.items():
        name = F.when((part == prefix) & wave.isin("sin", "cos"), F.lit(label)).otherwise(name)
    return name


def grouped(contributions: DataFrame) -> DataFrame:
    """Sine and cosine of one cycle as one row of the transaction; nothing is shuffled."""
    own = contributions.filter(~F.col("in_cycle"))
    return own.select("trans_num", _grouped_name().alias("feature"), F.coalesce("cycle", "contribution").alias("contribution"))


def global_importance(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature, cycles counted as one."""
    return (
        grouped(contributions)
        .groupBy("feature")
        .agg(F.avg(F.abs("contribution")).alias("importance"))
        .orderBy(F.col("importance").desc(), "feature")
    )


def contribution_curve(contributions: DataFrame, feature: str, width: float = 1.0) -> DataFrame:
    """Mean contribution along the values of one feature, in steps of `width`."""
    step = (F.floor(F.col("value") / F.lit(float(width))) * F.lit(float(width))).alias("value_from")
    return (
        contributions.filter(F.col("feature") == feature)
        .groupBy(step)
        .agg(F.avg("contribution").alias("mean_contribution"), F.count(F.lit(1)).alias("n_rows"))
        .orderBy("value_from")
    )


def local_explanation(contributions: DataFrame, trans_num: str) -> DataFrame:
    """Contributions to one transaction, strongest first."""
    own = grouped(contributions.filter(F.col("trans_num") == trans_num))
    return own.orderBy(F.abs("contribution").desc(), "feature")
