"""Retraining as one job: prepare, tune, fit, report, cross-validate, and store the model as its industry's new version."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession

from ..operators import metrics, models
from . import store


@dataclass
class Retrained:
    """The stored version, the trained model, and tables of the hold-out's report and of the folds' AUC."""

    version: int
    trained: models.Trained
    report: DataFrame
    folds: DataFrame | None


def retrain(
    spark: SparkSession, root: str, raw: DataFrame, industry: str, name: str, target: str, target_map: Mapping[str, int] | None, drop: Sequence[str], key: str,
    estimator: Estimator | None = None, grid: Mapping[str, Iterable] | None = models.RETRAIN_GRID, balance: str = "smote", folds: int = 5, test_size: float = 0.2,
) -> Retrained:
    """Train on `raw` and make the result the industry's current model; the one before stays current if anything fails.

    `balance` is "smote", "weights" or "none" and sees training rows only, in the folds too; without a grid the estimator's own
    parameters are used.
    """
    trained = models.train_industry(raw, industry, target, target_map, drop, key, estimator, grid, balance, test_size=test_size, folds=folds)
    report = metrics.classification_report(trained.holdout)
    version = store.save_model(spark, root, industry, name, trained.model, trained.prep, trained.params)
    return Retrained(version, trained, report, trained.folds)
