"""Transparent scoring and recommendation rules, built from Column expressions only."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import format_percent, parse_number, ref

# Base score, adjustments and clamp of the rule score.
BASE_SCORE = "0.35"
MONTH_TO_MONTH, TWO_YEAR = "0.25", "-0.20"
NEW_CUSTOMER, LONG_TENURE = "0.20", "-0.15"
HIGH_BILL, LOW_BILL = "0.10", "-0.10"
FIBER = "0.08"
FLOOR, CEILING = "0.03", "0.97"


def _dec(text: str) -> Column:
    return F.lit(Decimal(text)).cast("decimal(4,2)")


def clamp_score(score: Column) -> Column:
    return F.least(_dec(CEILING), F.greatest(_dec(FLOOR), score)).cast("decimal(4,2)")


def rule_score(
    columns: Iterable[str],
    contract: str = "Contract",
    tenure: str = "tenure",
    bill: str = "MonthlyCharges",
    internet: str = "InternetService",
) -> Column:
    """Churn score in [0.03, 0.97] as decimal(4,2).

    A rule takes part only when its column exists; a null value changes nothing.
    """
    present = set(columns)
    zero = _dec("0.00")
    parts = [_dec(BASE_SCORE)]
    if contract in present:
        c = ref(contract).cast("string")
        parts.append(F.when(c == "Month-to-month", _dec(MONTH_TO_MONTH)).when(c == "Two year", _dec(TWO_YEAR)).otherwise(zero))
    if tenure in present:
        t = parse_number(ref(tenure))
        parts.append(F.when(t < 6, _dec(NEW_CUSTOMER)).when(t > 36, _dec(LONG_TENURE)).otherwise(zero))
    if bill in present:
        m = parse_number(ref(bill))
        parts.append(F.when(m > 80, _dec(HIGH_BILL)).when(m < 40, _dec(LOW_BILL)).otherwise(zero))
    if internet in present:
        parts.append(F.when(ref(internet).cast("string") == "Fiber optic", _dec(FIBER)).otherwise(zero))
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return clamp_score(total)


def action_text(codes: Column, catalogue: dict[str, str], bill: Column | None = None, prob: Column | None = None) -> Column:
    """Replace each code of an array by the caller's text for it, with {bill} and {prob} filled in; a code without one stays."""
    book = F.create_map(*[F.lit(x) for item in catalogue.items() for x in item])
    bill_text = F.lit("") if bill is None else F.concat(F.lit("$"), F.format_number(bill.cast("double"), 0))
    prob_text = F.lit("") if prob is None else format_percent(prob)

    def render(code: Column) -> Column:
        text = F.coalesce(F.element_at(book, code), code)
        return F.replace(F.replace(text, F.lit("{bill}"), F.coalesce(bill_text, F.lit(""))), F.lit("{prob}"), F.coalesce(prob_text, F.lit("")))

    return F.transform(codes, render)


def recommend_rules(
    churns: Column,
    contract: Column,
    internet: Column,
    tenure: Column,
    bill: Column,
    senior: Column,
    tech: Column,
    paperless: Column,
) -> Column:
    """Action codes of one customer as an ordered array.

    `tenure` and `bill` are numeric; the caller decides what a missing value means.
    """
    at_risk = churns.cast("boolean")
    reasons = F.array_compact(
        F.array(
            F.when(contract.contains("Month-to-month"), F.lit("UPGRADE_CONTRACT")),
            F.when(tenure < 6, F.lit("ONBOARD")).when(tenure < 12, F.lit("FIRST_YEAR")),
            F.when(bill > 80, F.lit("BUNDLE")),
            F.when(internet.contains("Fiber optic"), F.lit("SERVICE_QUALITY")),
            F.when(senior == "Yes", F.lit("SENIOR_DESK")),
            F.when(tech == "No", F.lit("TRIAL_SUPPORT")),
            F.when(paperless == "Yes", F.lit("BILL_SUMMARY")),
        )
    )
    fallback = F.array(F.lit("CALL"), F.lit("REWARD"))
    stay = F.array_compact(
        F.array(
            F.lit("MAINTAIN"),
            F.when(tenure > 24, F.lit("LOYALTY")),
            F.when(bill < 50, F.lit("UPSELL")),
            F.lit("CHECKIN"),
        )
    )
    return F.when(at_risk, F.when(F.size(reasons) > 0, reasons).otherwise(fallback)).otherwise(stay)


def recommend_api(churns: Column, prob: Column, industry: Column) -> Column:
    """Short action list by industry and probability."""
    at_risk = churns.cast("boolean")
    telecom = industry == "telecom"
    banking = industry == "banking"
    shop = industry == "ecommerce"
    urgent = telecom & (prob > 0.7)
    act = F.array_compact(
        F.array(
            F.when(telecom, F.lit("CONTRACT_DISCOUNT")).when(banking, F.lit("MANAGER_CALL")).when(shop, F.lit("VOUCHER")),
            F.when(urgent, F.lit("RETENTION_AGENT")).when(banking, F.lit("PREMIUM_ACCOUNT")).when(shop, F.lit("CASHBACK")),
            F.when(urgent, F.lit("CALL_24H")),
            F.lit("ACT_NOW"),
        )
    )
    return F.when(at_risk, act).otherwise(F.array(F.lit("LOW_RISK"), F.lit("CONSIDER_UPSELL")))


def score_by_rules(df: DataFrame) -> DataFrame:
    """Bulk scoring: numeric score, its text, class and risk level, in one narrow stage."""
    from ..config import RISK_SHORT
    from .risk import prediction_text, risk_label

    scored = df.withColumn("Churn_Score", rule_score(df.columns))
    score = F.col("Churn_Score")
    return scored.withColumns(
        {
            "Churn_Probability": format_percent(score),
            "Churn_Prediction": prediction_text(score > _dec("0.50")),
            "Risk_Level": risk_label(score, RISK_SHORT),
        }
    )
