"""Revenue at risk, return on retention spend and its projection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import INDUSTRIES, RETENTION_COST, SUCCESS_RATE_PCT
from ..functions.text import format_count, format_money, format_rate, ref


def parameter_table(spark, overrides: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """One row per industry: monthly revenue, lifetime, cost per action and success rate."""
    rows = []
    for key, ind in INDUSTRIES.items():
        given = (overrides or {}).get(key, {})
        rows.append(
            (
                key,
                float(given.get("monthly", ind.monthly_revenue)),
                int(given.get("lifetime", ind.lifetime_months)),
                float(given.get("cost", RETENTION_COST)),
                int(given.get("success_rate", SUCCESS_RATE_PCT)),
            )
        )
    return spark.createDataFrame(rows, "industry string, monthly double, lifetime int, cost double, success_rate int")


def revenue_impact(df: DataFrame, churn: str, parameters: DataFrame, by: str = "industry") -> DataFrame:
    """`df` has one row per customer with its industry and a boolean or 0/1 churn column.

    The table is reduced to one row per industry before it meets the parameters.
    """
    at_risk = F.count_if(ref(churn).cast("boolean"))
    base = df.groupBy(ref(by)).agg(F.count("*").alias("total_customers"), at_risk.alias("predicted_churners"))
    c = F.col("predicted_churners")
    return (
        base.join(parameters, by)
        .withColumn("churn_rate_pct", F.try_divide(c * F.lit(100.0), F.col("total_customers").cast("double")))
        .withColumn("ltv", F.col("monthly") * F.col("lifetime"))
        .withColumn("monthly_loss", c * F.col("monthly"))
        .withColumn("annual_loss", F.col("monthly_loss") * F.lit(12.0))
        .withColumn("lifetime_loss", c * F.col("ltv"))
        .withColumn("customers_saved", F.expr("(predicted_churners * success_rate) div 100"))
        .withColumn("revenue_saved", F.col("customers_saved") * F.col("ltv"))
        .withColumn("retention_spend", c * F.col("cost"))
        .withColumn("net_benefit", F.col("revenue_saved") - F.col("retention_spend"))
        .withColumn(
            "roi_pct",
            F.when(F.col("retention_spend") > 0, F.col("net_benefit") / F.col("retention_spend") * F.lit(100.0)).otherwise(F.lit(0.0)),
        )
    )


def projection_12m(impact: DataFrame, by: str = "industry", months: int = 12) -> DataFrame:
    m = F.col("month")
    return impact.select(ref(by), "monthly_loss", "revenue_saved", F.explode(F.sequence(F.lit(1), F.lit(months))).alias("month")).select(
        ref(by), "month", (F.col("monthly_loss") * m).alias("cumulative_loss"), (F.col("revenue_saved") * (m / F.lit(12.0))).alias("cumulative_saved")
    )


def melt_kpis(impact: DataFrame, by: str = "industry") -> DataFrame:
    """The exported report: (industry, metric, value) with formatted values."""
    c = F.col
    # Names of the exported measures.
    lines = {
        "Total customers": c("total_customers").cast("string"),
        "Predicted churners": c("predicted_churners").cast("string"),
        "Churn rate": format_rate(c("churn_rate_pct"), 1),
        "Monthly loss": format_money(c("monthly_loss")),
        "Annual loss": format_money(c("annual_loss")),
        "Lifetime loss": format_money(c("lifetime_loss")),
        "Customers saved": c("customers_saved").cast("string"),
        "Revenue saved": format_money(c("revenue_saved")),
        "Campaign cost": format_money(c("retention_spend")),
        "Net benefit": format_money(c("net_benefit")),
        "ROI": format_rate(c("roi_pct"), 0),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in lines.items()])
    return impact.select(ref(by), F.explode(pairs).alias("e")).select(ref(by), "e.metric", "e.value")


def exec_summary(impact: DataFrame, by: str = "industry") -> DataFrame:
    """A short text per industry; the advice follows the sign of the net benefit."""
    c = F.col
    advice = F.when(c("net_benefit") > 0, "Start the retention campaign: it earns more than it costs.").otherwise(
        "Lower the cost per customer before starting a campaign."
    )
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Industry: "), ref(by)),
        F.concat(
            F.lit("At risk: "), format_count(c("predicted_churners")), F.lit(" of "), format_count(c("total_customers")),
            F.lit(" ("), format_rate(c("churn_rate_pct"), 1), F.lit(")"),
        ),
        F.concat(F.lit("Loss per month: "), format_money(c("monthly_loss"))),
        F.concat(F.lit("Loss per year: "), format_money(c("annual_loss"))),
        F.concat(F.lit("Lifetime loss: "), format_money(c("lifetime_loss"))),
        F.concat(F.lit("Can be saved: "), format_count(c("customers_saved")), F.lit(" customers, "), format_money(c("revenue_saved"))),
        F.concat(F.lit("Campaign: "), format_money(c("retention_spend"))),
        F.concat(F.lit("Net benefit: "), format_money(c("net_benefit")), F.lit(", return "), format_rate(c("roi_pct"), 0)),
        F.concat(F.lit("Advice: "), advice),
    )
    return impact.select(ref(by), text.alias("summary"))
