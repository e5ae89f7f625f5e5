"""Exact thresholds and odd inputs of the scalar functions."""

from decimal import Decimal

from pyspark.sql import functions as F

from holdfast.config import RISK_SHORT
from holdfast.functions import risk, rules, text


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_risk_cutoffs_are_strict(spark):
    got = column(spark, [0.40, 0.4001, 0.65, 0.6501, 0.0, 1.0, None, float("nan")], "double", lambda v: risk.risk_label(v, RISK_SHORT))
    assert got == ["Low", "Medium", "Medium", "High", "Low", "High", None, None]


def test_risk_color(spark):
    assert column(spark, [0.1, 0.5, 0.9, None], "double", risk.risk_color) == ["green", "orange", "red", None]


def test_confidence_cutoffs(spark):
    values = [0.15, 0.1499, 0.30, 0.2999, 0.45, 0.4499, 0.55, 0.5501, 0.70, 0.7001, 0.85, 0.8501, None]
    want = ["High", "Very High", "Medium", "High", "Low", "Medium", "Low", "Medium", "Medium", "High", "High", "Very High", None]
    assert column(spark, values, "double", risk.confidence_band) == want


def test_parse_number(spark):
    values = [" ", "", "12.5", "abc", "1e3", None, "12d", "3f", " 7 ", "NaN", "-0.5", "12,5"]
    assert column(spark, values, "string", text.parse_number) == [None, None, 12.5, None, 1000.0, None, None, None, 7.0, None, -0.5, None]


def test_parse_texts(spark):
    assert column(spark, ["12 months", "3 years", "7", None, "0 months"], "string", text.parse_months) == [12, None, 7, None, 0]
    assert column(spark, ["$65", "65.5", "$5000/month", None], "string", text.parse_money) == [65.0, 65.5, None, None]
    got = column(spark, ["33.63%", "0%", "abc%", "0.5", None], "string", text.parse_percent)
    assert [None if g is None else round(g, 9) for g in got] == [0.3363, 0.0, None, None, None]


def test_formats_are_half_even(spark):
    assert column(spark, [0.125, 0.135, 0.6, 12.5], "double", lambda v: text.format_percent(v, 0)) == ["12%", "14%", "60%", "1250%"]
    assert column(spark, [0.3363, 1.0], "double", lambda v: text.format_percent(v, 2)) == ["33.63%", "100.00%"]
    assert column(spark, [1234.5, 1235.5, -9.9], "double", text.format_money) == ["$1,234", "$1,236", "$-10"]


def test_pattern_flag(spark):
    values = ["WILL CHURN", "WILL STAY", "Yes", "No", "1", "0", "10", None]
    assert column(spark, values, "string", text.flag_by_pattern) == [True, False, True, False, True, False, True, False]
    assert column(spark, values, "string", text.flag_strict) == [True, False, True, False, True, False, False, False]


def test_rule_score_thresholds(spark):
    rows = [
        ("Month-to-month", 5.0, 80.01, "Fiber optic"),
        ("Month-to-month", 6.0, 80.0, "DSL"),
        ("One year", 36.0, 40.0, "No"),
        ("Two year", 37.0, 39.99, "DSL"),
        (None, None, None, None),
        ("Two year", float("nan"), 50.0, "Fiber optic"),
    ]
    df = spark.createDataFrame(rows, "Contract string, tenure double, MonthlyCharges double, InternetService string")
    got = [r[0] for r in df.select(rules.rule_score(df.columns)).collect()]
    assert got == [Decimal(x) for x in ("0.97", "0.60", "0.35", "0.03", "0.35", "0.23")]


def test_rule_score_uses_present_columns_only(spark):
    df = spark.createDataFrame([(3,)], "tenure int")
    assert df.select(rules.rule_score(df.columns)).first()[0] == Decimal("0.55")
    none = spark.createDataFrame([(3,)], "other int")
    assert none.select(rules.rule_score(none.columns)).first()[0] == Decimal("0.35")


def recommend(spark, row):
    df = spark.createDataFrame([row], "pred int, contract string, internet string, tenure int, bill double, senior string, tech string, paperless string")
    return df.select(rules.recommend_rules(*[F.col(c) for c in df.columns])).first()[0]


def test_recommend_rules(spark):
    assert recommend(spark, (1, "Month-to-month", "Fiber optic", 5, 80.01, "Yes", "No", "Yes")) == [
        "UPGRADE_CONTRACT", "ONBOARD", "BUNDLE", "SERVICE_QUALITY", "SENIOR_DESK", "TRIAL_SUPPORT", "BILL_SUMMARY",
    ]
    assert recommend(spark, (1, "Two year", "DSL", 12, 80.0, "No", "Yes", "No")) == ["CALL", "REWARD"]
    assert recommend(spark, (1, "Two year", "DSL", 11, 80.0, "No", "Yes", "No")) == ["FIRST_YEAR"]
    assert recommend(spark, (0, "Two year", "DSL", 25, 49.0, "No", "Yes", "No")) == ["MAINTAIN", "LOYALTY", "UPSELL", "CHECKIN"]
    assert recommend(spark, (0, "Two year", "DSL", 24, 50.0, "No", "Yes", "No")) == ["MAINTAIN", "CHECKIN"]


def test_action_text_fills_in_values(spark):
    df = spark.createDataFrame([(["BUNDLE", "ACT_NOW", "OTHER"], 91.6, 0.6)], "c array<string>, b double, p double")
    texts = df.select(rules.action_text(F.col("c"), {"BUNDLE": "less than {bill}", "ACT_NOW": "now {prob}"}, F.col("b"), F.col("p"))).first()[0]
    assert texts == ["less than $92", "now 60%", "OTHER"]


def test_null_to_list_caps_after_dropping_nulls(spark):
    df = spark.createDataFrame([("a", None, "c")], "x string, y string, z string")
    assert df.select(text.null_to_list(F.col("x"), F.col("y"), F.col("z"), limit=2)).first()[0] == ["a", "c"]
