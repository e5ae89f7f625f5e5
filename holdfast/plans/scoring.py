"""Rule scores, risk bands, recommendations and bulk scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import risk, rules, text
from ..functions.text import ref
from ..operators import dashboard, serve
from ..sources import views
from . import oracle_views as V
from .registry import query

_CLASS = "CASE WHEN score > 0.5 THEN 'WILL CHURN' ELSE 'WILL STAY' END"
_SHORT = "CASE WHEN score > 0.65 THEN 'High' WHEN score > 0.4 THEN 'Medium' ELSE 'Low' END"


@query(
    "rule_score",
    f"""WITH {V.ACCOUNTS}, {V.RULE_SCORE}
    SELECT "customerID", score::DOUBLE AS "Churn_Score", (score * 100)::INTEGER || '%' AS "Churn_Probability",
      {_CLASS} AS "Churn_Prediction", {_SHORT} AS "Risk_Level" FROM scored""",
)
def rule_score(spark: SparkSession, base: str) -> DataFrame:
    scored = rules.score_by_rules(views.accounts(spark, base))
    return scored.select("customerID", F.col("Churn_Score").cast("double").alias("Churn_Score"), "Churn_Probability", "Churn_Prediction", "Risk_Level")


@query(
    "bulk_summary",
    f"""WITH {V.ACCOUNTS}, {V.RULE_SCORE}, t AS (SELECT {_CLASS} AS p, {_SHORT} AS r FROM scored)
    SELECT count(*) AS customers, count(*) FILTER (p = 'WILL CHURN') AS will_churn,
      round_even(count(*) FILTER (p = 'WILL CHURN')::DOUBLE / count(*)::DOUBLE * 100, 1) AS churn_rate,
      count(*) FILTER (r = 'High') AS high, count(*) FILTER (r = 'Medium') AS medium, count(*) FILTER (r = 'Low') AS low FROM t""",
)
def bulk_summary(spark: SparkSession, base: str) -> DataFrame:
    return dashboard.bulk_summary(rules.score_by_rules(views.accounts(spark, base)))


def _probabilities(spark: SparkSession, base: str) -> DataFrame:
    return views.predictions(spark, base).select("id", F.col("churn_probability").alias("p"))


def _per_prediction(name: str, expression, sql: str) -> None:
    @query(name, f"WITH {V.PREDICTIONS} SELECT id, {sql} AS {name} FROM (SELECT id, churn_probability AS p FROM predictions) t")
    def run(spark: SparkSession, base: str) -> DataFrame:
        return _probabilities(spark, base).select("id", expression(F.col("p")).alias(name))


_per_prediction("risk_label", risk.risk_label, "CASE WHEN p > 0.65 THEN 'High Risk' WHEN p > 0.4 THEN 'Medium Risk' ELSE 'Low Risk' END")
_per_prediction("risk_color", risk.risk_color, "CASE WHEN p > 0.65 THEN 'red' WHEN p > 0.4 THEN 'orange' ELSE 'green' END")
_per_prediction(
    "confidence_band",
    risk.confidence_band,
    "CASE WHEN p > 0.85 OR p < 0.15 THEN 'Very High' WHEN p > 0.7 OR p < 0.3 THEN 'High' WHEN p > 0.55 OR p < 0.45 THEN 'Medium' ELSE 'Low' END",
)
_per_prediction("prediction_text", lambda p: risk.prediction_text(p > 0.5), "CASE WHEN p > 0.5 THEN 'WILL CHURN' ELSE 'WILL STAY' END")
_per_prediction("format_percent", lambda p: text.format_percent(p, 2), "printf('%.2f', p * 100) || '%'")


@query(
    "action_priority",
    f"""WITH {V.PREDICTIONS} SELECT id, CASE WHEN churn_probability > 0.5 THEN 'Immediate' ELSE 'Standard' END AS priority,
      CASE WHEN churn_probability > 0.5 THEN 'HIGH CHURN RISK' ELSE 'LOW CHURN RISK' END AS headline FROM predictions""",
)
def action_priority(spark: SparkSession, base: str) -> DataFrame:
    churns = F.col("p") > 0.5
    return _probabilities(spark, base).select("id", risk.action_priority(churns).alias("priority"), risk.headline(churns).alias("headline"))


def _parsed(name: str, column: str, parser, sql: str) -> None:
    @query(name, f"WITH {V.PREDICTIONS} SELECT id, {sql} AS parsed FROM predictions")
    def run(spark: SparkSession, base: str) -> DataFrame:
        return views.predictions(spark, base).select("id", parser(F.col(column)).alias("parsed"))


_parsed("parse_months", "tenure", text.parse_months, "regexp_extract(tenure, '^[0-9]+')::INTEGER")
_parsed("parse_money", "monthly_charges", text.parse_money, "substr(monthly_charges, 2)::DOUBLE")
_parsed("parse_percent", "probability_text", text.parse_percent, "replace(probability_text, '%', '')::DOUBLE / 100")


@query(
    "format_money",
    """SELECT o_orderkey AS id, '$' || format('{:,}', round_even(o_totalprice, 0)::BIGINT) AS amount FROM orders""",
)
def format_money(spark: SparkSession, base: str) -> DataFrame:
    return views.table(spark, base, "orders").select(F.col("o_orderkey").alias("id"), text.format_money(F.col("o_totalprice")).alias("amount"))


@query(
    "clean_feature_name",
    f"""WITH {V.ACCOUNTS} SELECT "customerID", substr(replace('PaymentMethod_' || coalesce("PaymentMethod", 'none') || '_' || "Contract", '_', ' '), 1, 30) AS name
    FROM accounts""",
)
def clean_feature_name(spark: SparkSession, base: str) -> DataFrame:
    raw = F.concat(F.lit("PaymentMethod_"), F.coalesce("PaymentMethod", F.lit("none")), F.lit("_"), F.col("Contract"))
    return views.accounts(spark, base).select("customerID", text.clean_feature_name(raw).alias("name"))


@query(
    "clamp_score",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      least(0.97, greatest(0.03, (l_extendedprice / 100000.0::DOUBLE)::DECIMAL(4,2)))::DOUBLE AS score FROM lineitem""",
)
def clamp_score(spark: SparkSession, base: str) -> DataFrame:
    line = views.table(spark, base, "lineitem")
    raw = (F.col("l_extendedprice") / F.lit(100000.0)).cast("decimal(4,2)")
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rules.clamp_score(raw).cast("double").alias("score"))


@query(
    "null_to_list",
    f"""WITH {V.ACCOUNTS} SELECT "customerID",
      array_to_string(list_filter(["PaymentMethod", CASE WHEN tenure < 6 THEN 'new' END, CASE WHEN "Churn" = 'Yes' THEN 'gone' END,
        "Contract", "InternetService", 'rest'], lambda x: x IS NOT NULL)[1:5], ';') AS items FROM accounts""",
)
def null_to_list(spark: SparkSession, base: str) -> DataFrame:
    items = text.null_to_list(
        F.col("PaymentMethod"), F.when(F.col("tenure") < 6, "new"), F.when(F.col("Churn") == "Yes", "gone"),
        F.col("Contract"), F.col("InternetService"), F.lit("rest"),
    )
    return views.accounts(spark, base).select("customerID", F.array_join(items, ";").alias("items"))


@query(
    "recommend_rules",
    f"""WITH {V.ACCOUNTS}, {V.RULE_SCORE}, r AS (SELECT *, concat_ws(';',
        CASE WHEN contains("Contract", 'Month-to-month') THEN 'UPGRADE_CONTRACT' END,
        CASE WHEN tenure < 6 THEN 'ONBOARD' WHEN tenure < 12 THEN 'FIRST_YEAR' END,
        CASE WHEN "MonthlyCharges" > 80 THEN 'BUNDLE' END,
        CASE WHEN contains("InternetService", 'Fiber optic') THEN 'SERVICE_QUALITY' END,
        CASE WHEN "SeniorCitizen" = 1 THEN 'SENIOR_DESK' END,
        CASE WHEN "TechSupport" = 'No' THEN 'TRIAL_SUPPORT' END,
        CASE WHEN "PaperlessBilling" = 'Yes' THEN 'BILL_SUMMARY' END) AS reasons FROM scored)
    SELECT "customerID", CASE WHEN score > 0.5 THEN CASE WHEN reasons = '' THEN 'CALL;REWARD' ELSE reasons END
      ELSE concat_ws(';', 'MAINTAIN', CASE WHEN tenure > 24 THEN 'LOYALTY' END, CASE WHEN "MonthlyCharges" < 50 THEN 'UPSELL' END, 'CHECKIN')
      END AS actions FROM r""",
)
def recommend_rules(spark: SparkSession, base: str) -> DataFrame:
    scored = rules.score_by_rules(views.accounts(spark, base))
    actions = rules.recommend_rules(
        F.col("Churn_Prediction") == "WILL CHURN",
        ref("Contract"), ref("InternetService"), ref("tenure"), ref("MonthlyCharges"),
        F.when(ref("SeniorCitizen") == 1, "Yes").otherwise("No"), ref("TechSupport"), ref("PaperlessBilling"),
    )
    return scored.select("customerID", F.array_join(actions, ";").alias("actions"))


@query(
    "recommend_api",
    f"""WITH {V.PREDICTIONS}, t AS (SELECT id, churn_probability AS p, (['telecom', 'banking', 'ecommerce'])[id % 3 + 1] AS industry FROM predictions)
    SELECT id, industry, CASE WHEN p > 0.5 THEN concat_ws(';',
        CASE industry WHEN 'telecom' THEN 'CONTRACT_DISCOUNT' || CASE WHEN p > 0.7 THEN ';RETENTION_AGENT;CALL_24H' ELSE '' END
          WHEN 'banking' THEN 'MANAGER_CALL;PREMIUM_ACCOUNT' ELSE 'VOUCHER;CASHBACK' END, 'ACT_NOW')
      ELSE 'LOW_RISK;CONSIDER_UPSELL' END AS actions,
      CASE WHEN p > 0.5 THEN 'now ' || printf('%.0f', p * 100) || '%' ELSE 'CONSIDER_UPSELL' END AS closing FROM t""",
)
def recommend_api(spark: SparkSession, base: str) -> DataFrame:
    industry = F.element_at(F.array(F.lit("telecom"), F.lit("banking"), F.lit("ecommerce")), (F.col("id") % 3 + 1).cast("int"))
    rows = _probabilities(spark, base).withColumn("industry", industry)
    codes = rules.recommend_api(F.col("p") > 0.5, F.col("p"), F.col("industry"))
    closing = F.element_at(rules.action_text(codes, {"ACT_NOW": "now {prob}"}, prob=F.col("p")), -1)
    return rows.select("id", "industry", F.array_join(codes, ";").alias("actions"), closing.alias("closing"))


@query(
    "flag_by_pattern",
    f"""WITH {V.PREDICTIONS} SELECT id, coalesce(regexp_matches(prediction, '(?i)churn|1|yes'), false) AS by_class,
      coalesce(regexp_matches(tenure, '(?i)churn|1|yes'), false) AS by_tenure, prediction = 'CHURN' AS strict_class FROM predictions""",
)
def flag_by_pattern(spark: SparkSession, base: str) -> DataFrame:
    log = views.predictions(spark, base)
    return log.select(
        "id",
        text.flag_by_pattern(F.col("prediction")).alias("by_class"),
        text.flag_by_pattern(F.col("tenure")).alias("by_tenure"),
        text.flag_strict(F.col("prediction")).alias("strict_class"),
    )


@query(
    "senior_flag",
    f"""WITH {V.CLIENTS} SELECT "CustomerId", CASE WHEN "Age" >= 60 THEN 'Yes' ELSE 'No' END AS senior FROM clients""",
)
def senior_flag(spark: SparkSession, base: str) -> DataFrame:
    return views.clients(spark, base).select("CustomerId", serve.senior_flag(F.col("Age")).alias("senior"))


@query(
    "display_record",
    f"""WITH {V.CLIENTS} SELECT "CustomerId", ("Tenure"::INTEGER) || ' years' AS tenure,
      '$' || printf('%.0f', "EstimatedSalary" / 12) || '/month' AS monthly_charges, "NumOfProducts" || ' product(s)' AS contract,
      "Geography" AS internet, "Gender" AS payment, CASE WHEN "Age" >= 60 THEN 'Yes' ELSE 'No' END AS senior,
      'Balance $' || format('{{:,}}', round_even("Balance", 0)::BIGINT) AS partner,
      CASE WHEN "IsActiveMember" = 1 THEN 'Active' ELSE 'Inactive' END AS tech_support,
      CASE WHEN "HasCrCard" = 1 THEN 'Yes' ELSE 'No' END AS paperless FROM clients""",
)
def display_record(spark: SparkSession, base: str) -> DataFrame:
    return serve.display_record(views.clients(spark, base), "banking").select("CustomerId", "display.*")
