"""Drift check, retraining when needed, and fresh rules: the daily cycle."""

from __future__ import annotations

from dataclasses import dataclass

from datetime import datetime

from pyspark.sql import DataFrame

from cardwatch.operators import features as ft
from cardwatch.operators.drift import drift_report, needs_retrain
from cardwatch.operators.filters import outlier_filter
from cardwatch.operators.rules import mine_categories, mine_cyclic, mine_thresholds, rules_document
from cardwatch.operators.sampling import balanced_sample
from cardwatch.plans.champions import FIGURE, Registry
from cardwatch.plans.explain import contribution_rows, linear_weights
from cardwatch.plans.training import SearchResult, search, train_lr
from cardwatch.session import durable


def mine_rules(contributions: DataFrame) -> DataFrame:
    """The rule document read off attribution rows."""
    rows = durable(contributions, "contributions")
    return rules_document(mine_thresholds(rows), mine_categories(rows), mine_cyclic(rows))


def rules_from(df: DataFrame, quotas: dict[int, int] | None = None) -> DataFrame:
    """Rules from a linear model's attributions of all rows, or of a balanced sample if `quotas` are given."""
    return rules_from_features(durable(ft.engineered(df), "rule-input"), quotas)


def rules_from_features(rows: DataFrame, quotas: dict[int, int] | None = None) -> DataFrame:
    """As `rules_from`, for stored rows that carry the features."""
    weights = linear_weights(train_lr(rows))
    return mine_rules(contribution_rows(balanced_sample(rows, quotas) if quotas else rows, weights))


@dataclass(frozen=True)
class Cycle:
    verdict: DataFrame
    details: DataFrame
    retrained: SearchResult | None
    rules: DataFrame
    promoted: bool = False


def keep_best(registry: Registry, experiment: str, found: SearchResult, started: datetime) -> bool:
    """Stores the model and the run of a search; it becomes champion if its F2 on unseen rows is the highest so far."""
    figures = {name: float(value) for name, value in found.figures.drop("run_name").first().asDict().items() if value is not None}
    run = registry.record(experiment, "best_of_search", found.model, figures, found.best, started)
    return registry.challenge(run, figures[FIGURE])


def daily_cycle(df: DataFrame, day: str, n_trials: int = 100, registry: Registry | None = None, started: datetime | None = None, **search_options) -> Cycle:
    """Only the verdict and the scores of trials reach the driver.

    With a registry, what a retraining finds is stored there under the day's name, `started` being the time
    of its run, and becomes champion if it beats the present one.
    """
    rows = durable(ft.engineered(df), "cycle")
    verdict, details = drift_report(rows, day)
    verdict, details = durable(verdict, "verdict"), durable(details, "drift")
    retrained, promoted = None, False
    if needs_retrain(verdict).first()["retrain"]:
        retrained = search(outlier_filter(rows), n_trials, **search_options)
        if registry:
            promoted = keep_best(registry, f"retrain-{day}", retrained, started or datetime.fromisoformat(day))
    return Cycle(verdict, details, retrained, rules_from_features(rows), promoted)
