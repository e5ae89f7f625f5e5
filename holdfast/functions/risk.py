"""Risk bands and texts derived from a churn probability or class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import HIGH_RISK, MEDIUM_RISK, RISK_LABELS


def _banded(prob: Column, values: tuple[str, str, str], high: float, medium: float) -> Column:
    p = prob.cast("double")
    band = F.when(p > F.lit(high), F.lit(values[0])).when(p > F.lit(medium), F.lit(values[1])).otherwise(F.lit(values[2]))
    return F.when(p.isNotNull() & ~F.isnan(p), band)


def risk_label(
    prob: Column,
    labels: tuple[str, str, str] = RISK_LABELS,
    high: float = HIGH_RISK,
    medium: float = MEDIUM_RISK,
) -> Column:
    """Strictly above `high`, strictly above `medium`, or below; null and NaN give null."""
    return _banded(prob, labels, high, medium)


def risk_color(prob: Column) -> Column:
    return _banded(prob, ("red", "orange", "green"), HIGH_RISK, MEDIUM_RISK)


def confidence_band(prob: Column) -> Column:
    # Distance of the probability from one half, by band.
    p = prob.cast("double")
    band = (
        F.when((p > 0.85) | (p < 0.15), "Very High")
        .when((p > 0.70) | (p < 0.30), "High")
        .when((p > 0.55) | (p < 0.45), "Medium")
        .otherwise("Low")
    )
    return F.when(p.isNotNull() & ~F.isnan(p), band)


def prediction_text(churns: Column, yes: str = "WILL CHURN", no: str = "WILL STAY") -> Column:
    """`churns` is a boolean or 0/1 column."""
    return F.when(churns.cast("boolean"), F.lit(yes)).when(~churns.cast("boolean"), F.lit(no))


def action_priority(churns: Column) -> Column:
    # Report wording of the two priorities and headlines.
    urgent = churns.cast("boolean")
    return F.when(urgent, F.lit("Immediate")).when(~urgent, F.lit("Standard"))


def headline(churns: Column) -> Column:
    likely = churns.cast("boolean")
    return F.when(likely, F.lit("HIGH CHURN RISK")).when(~likely, F.lit("LOW CHURN RISK"))
