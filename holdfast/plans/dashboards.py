"""Churn rates, headline numbers and the data profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BANKING, ECOMMERCE, TELECOM
from ..operators import clean, dashboard, profile
from ..sources import views
from . import oracle_views as V
from .registry import query

ALL_VIEWS = f"WITH {V.ACCOUNTS}, {V.CLIENTS}, {V.SHOPPERS}"
_TELECOM_FLAG = """CASE WHEN "Churn" = 'Yes' THEN 1 ELSE 0 END"""
_RATE = "round_even(avg(churn) * 100, 1)"


def telecom(spark: SparkSession, base: str) -> DataFrame:
    return dashboard.with_churn(views.accounts(spark, base), "Churn", TELECOM.target_map)


def banking(spark: SparkSession, base: str) -> DataFrame:
    return dashboard.with_churn(views.clients(spark, base), "Exited", BANKING.target_map)


def ecommerce(spark: SparkSession, base: str) -> DataFrame:
    return dashboard.with_churn(views.shoppers(spark, base), "Churn", ECOMMERCE.target_map, "churn_flag").drop("Churn").withColumnRenamed("churn_flag", "churn")


_SOURCES = {
    "Contract": (telecom, "accounts", _TELECOM_FLAG),
    "InternetService": (telecom, "accounts", _TELECOM_FLAG),
    "Geography": (banking, "clients", '"Exited"'),
    "NumOfProducts": (banking, "clients", '"Exited"'),
    "PreferredLoginDevice": (ecommerce, "shoppers", '"Churn"'),
    "SatisfactionScore": (ecommerce, "shoppers", '"Churn"'),
    "Complain": (ecommerce, "shoppers", '"Churn"'),
}
_VIEW_SQL = {"accounts": V.ACCOUNTS, "clients": V.CLIENTS, "shoppers": V.SHOPPERS}


def _register_dimension(dimension: str) -> None:
    load, view, flag = _SOURCES[dimension]

    @query(
        f"churn_rate_by_dim_{dimension}",
        f"""WITH {_VIEW_SQL[view]} SELECT dim AS "{dimension}", {_RATE} AS churn_rate, count(*) AS customers
        FROM (SELECT "{dimension}" AS dim, {flag} AS churn FROM {view}) t WHERE dim IS NOT NULL GROUP BY 1""",
    )
    def run(spark: SparkSession, base: str) -> DataFrame:
        return dashboard.churn_rate_by_dim(load(spark, base), dimension)


for _d in _SOURCES:
    _register_dimension(_d)


@query(
    "churn_rate_by_dim",
    f"""WITH {V.ACCOUNTS} SELECT "Contract", {_RATE} AS churn_rate, count(*) AS customers
    FROM (SELECT "Contract", {_TELECOM_FLAG} AS churn FROM accounts) t GROUP BY 1""",
)
def churn_rate_by_dim(spark: SparkSession, base: str) -> DataFrame:
    return dashboard.churn_rate_by_dim(telecom(spark, base), "Contract")


@query(
    "churn_rate_multi_dim",
    f"""WITH {V.ACCOUNTS}, t AS (SELECT "Contract", "InternetService", "PaymentMethod", {_TELECOM_FLAG} AS churn FROM accounts)
    SELECT 'Contract' AS dimension, "Contract" AS value, {_RATE} AS churn_rate, count(*) AS customers FROM t GROUP BY 2
    UNION ALL SELECT 'InternetService', "InternetService", {_RATE}, count(*) FROM t GROUP BY 2
    UNION ALL SELECT 'PaymentMethod', "PaymentMethod", {_RATE}, count(*) FROM t WHERE "PaymentMethod" IS NOT NULL GROUP BY 2""",
)
def churn_rate_multi_dim(spark: SparkSession, base: str) -> DataFrame:
    return dashboard.churn_rate_multi_dim(telecom(spark, base), ["Contract", "InternetService", "PaymentMethod"])


def _kpi_sql(view: str, flag: str, measure: str, digits: int) -> str:
    return f"""SELECT count(*) AS customers, sum({flag})::BIGINT AS churned,
      round_even(sum({flag})::DOUBLE / count(*)::DOUBLE * 100, 1) AS churn_rate, round_even(avg("{measure}"), {digits}) AS average FROM {view}"""


@query(
    "industry_kpis",
    f"""{ALL_VIEWS}
    SELECT 'telecom' AS industry, * FROM ({_kpi_sql("accounts", _TELECOM_FLAG, "MonthlyCharges", 2)}) a
    UNION ALL SELECT 'banking', * FROM ({_kpi_sql("clients", '"Exited"', "Balance", 2)}) b
    UNION ALL SELECT 'ecommerce', * FROM ({_kpi_sql("shoppers", '"Churn"', "SatisfactionScore", 1)}) c""",
)
def industry_kpis(spark: SparkSession, base: str) -> DataFrame:
    parts = {
        ind.key: dashboard.industry_kpis(load(spark, base), *ind.kpi).withColumn("industry", F.lit(ind.key))
        for ind, load in ((TELECOM, telecom), (BANKING, banking), (ECOMMERCE, ecommerce))
    }
    return parts["telecom"].unionByName(parts["banking"]).unionByName(parts["ecommerce"])


def stacked(spark: SparkSession, base: str) -> DataFrame:
    return dashboard.union_industries({"telecom": telecom(spark, base), "banking": banking(spark, base), "ecommerce": ecommerce(spark, base)})


_STACKED = f"""stacked AS (SELECT 'telecom' AS industry, {_TELECOM_FLAG} AS churn FROM accounts
  UNION ALL SELECT 'banking', "Exited" FROM clients UNION ALL SELECT 'ecommerce', "Churn" FROM shoppers)"""


@query("union_industries", f"{ALL_VIEWS}, {_STACKED} SELECT industry, churn, count(*) AS n FROM stacked GROUP BY 1, 2")
def union_industries(spark: SparkSession, base: str) -> DataFrame:
    return stacked(spark, base).groupBy("industry", "churn").agg(F.count("*").alias("n"))


@query(
    "platform_overview",
    f"""{ALL_VIEWS}, {_STACKED} SELECT count(*) AS customers, sum(churn)::BIGINT AS churned, (count(*) - sum(churn))::BIGINT AS retained,
      round_even(sum(churn)::DOUBLE / count(*)::DOUBLE * 100, 1) AS churn_rate FROM stacked""",
)
def platform_overview(spark: SparkSession, base: str) -> DataFrame:
    return dashboard.platform_overview(stacked(spark, base))


@query("class_counts", f"""WITH {V.ACCOUNTS} SELECT "Churn", count(*) AS n FROM accounts GROUP BY 1""")
def class_counts(spark: SparkSession, base: str) -> DataFrame:
    return profile.class_counts(views.accounts(spark, base), "Churn")


@query(
    "count_by_hue",
    f"""WITH {V.ACCOUNTS} SELECT "Contract", count(*) FILTER ("Churn" = 'No') AS "No", count(*) FILTER ("Churn" = 'Yes') AS "Yes" FROM accounts GROUP BY 1""",
)
def count_by_hue(spark: SparkSession, base: str) -> DataFrame:
    return profile.count_by_hue(views.accounts(spark, base), "Contract", "Churn", ["No", "Yes"])


def _describe_sql(column: str) -> str:
    c = f'"{column}"'
    return f"""SELECT '{column}' AS "column", count({c}) AS "count", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min,
      round(quantile_cont({c}, 0.25)::DOUBLE, 6) AS q25, round(quantile_cont({c}, 0.5)::DOUBLE, 6) AS q50, round(quantile_cont({c}, 0.75)::DOUBLE, 6) AS q75, max({c})::DOUBLE AS max FROM d"""


@query(
    "describe",
    f"""WITH {V.ACCOUNTS}, d AS (SELECT tenure, "MonthlyCharges", total_num AS "TotalCharges", "SeniorCitizen" FROM accounts)
    {_describe_sql("tenure")} UNION ALL {_describe_sql("MonthlyCharges")} UNION ALL {_describe_sql("TotalCharges")} UNION ALL {_describe_sql("SeniorCitizen")}""",
)
def describe(spark: SparkSession, base: str) -> DataFrame:
    df = clean.coerce_numeric(views.accounts(spark, base), ["TotalCharges"])
    stats = profile.describe(df, ["tenure", "MonthlyCharges", "TotalCharges", "SeniorCitizen"])
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "q50", "q75")})


@query(
    "profile_nulls",
    f"""WITH {V.SHOPPERS} SELECT 'WarehouseToHome' AS "column", 'double' AS dtype, count("WarehouseToHome") AS non_null, count(*) - count("WarehouseToHome") AS missing FROM shoppers
    UNION ALL SELECT 'HourSpendOnApp', 'double', count("HourSpendOnApp"), count(*) - count("HourSpendOnApp") FROM shoppers
    UNION ALL SELECT 'Gender', 'string', count("Gender"), count(*) - count("Gender") FROM shoppers
    UNION ALL SELECT 'CityTier', 'int', count("CityTier"), count(*) - count("CityTier") FROM shoppers""",
)
def profile_nulls(spark: SparkSession, base: str) -> DataFrame:
    df = views.shoppers(spark, base).select("WarehouseToHome", "HourSpendOnApp", "Gender", "CityTier")
    return profile.profile_nulls(df)


@query(
    "box_stats",
    f"""WITH {V.ACCOUNTS}, q AS (SELECT "Churn" AS c, quantile_cont("MonthlyCharges", 0.25) AS q1, quantile_cont("MonthlyCharges", 0.5) AS median,
        quantile_cont("MonthlyCharges", 0.75) AS q3 FROM accounts GROUP BY 1),
      f AS (SELECT a."Churn", q.*, a."MonthlyCharges" AS v, v >= q1 - 1.5::DOUBLE * (q3 - q1) AND v <= q3 + 1.5::DOUBLE * (q3 - q1) AS ok FROM accounts a JOIN q ON q.c = a."Churn")
    SELECT "Churn", min(v) FILTER (ok) AS whisker_low, max(v) FILTER (ok) AS whisker_high, count(*) FILTER (NOT ok) AS outliers,
      round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3 FROM f GROUP BY 1""",
)
def box_stats(spark: SparkSession, base: str) -> DataFrame:
    stats = profile.box_stats(views.accounts(spark, base), "MonthlyCharges", "Churn")
    return stats.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query(
    "histogram_by_class",
    f"""WITH {V.ACCOUNTS}, b AS (SELECT "Churn" AS cls, min(tenure)::DOUBLE AS lo, max(tenure)::DOUBLE AS hi FROM accounts GROUP BY 1),
      n AS (SELECT a."Churn" AS cls, least(floor((tenure - lo) / ((hi - lo) / 20)), 19)::INTEGER AS bin, count(*) AS n
        FROM accounts a JOIN b ON b.cls = a."Churn" GROUP BY 1, 2)
    SELECT b.cls, g.bin::INTEGER AS bin, round(lo + (hi - lo) / 20 * g.bin, 6) AS "left", round(lo + (hi - lo) / 20 * (g.bin + 1), 6) AS "right", coalesce(n.n, 0) AS n
    FROM b CROSS JOIN (SELECT unnest(range(20)) AS bin) g LEFT JOIN n ON n.cls = b.cls AND n.bin = g.bin""",
)
def histogram_by_class(spark: SparkSession, base: str) -> DataFrame:
    h = profile.histogram_by_class(views.accounts(spark, base), "tenure", "Churn")
    return h.withColumns({c: F.round(c, 6) for c in ("left", "right")})


@query(
    "preview",
    f"""WITH {V.ACCOUNTS} SELECT "customerID", tenure, "Contract" FROM accounts ORDER BY "customerID" LIMIT 5""",
)
def preview(spark: SparkSession, base: str) -> DataFrame:
    return dashboard.preview(views.accounts(spark, base).select("customerID", "tenure", "Contract"), 5, "customerID")
