"""Streams over the given tables, compared with the batch result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import views
from ..sources.writers import write_features
from ..streaming import flows
from . import oracle_views as V
from .registry import query


@query(
    "stream_score",
    f"""WITH {V.ACCOUNTS}, {V.RULE_SCORE} SELECT "customerID", score::DOUBLE AS "Churn_Score", CASE WHEN score > 0.65 THEN 'High' WHEN score > 0.4 THEN 'Medium' ELSE 'Low' END AS "Risk_Level" FROM scored""",
)
def stream_score(spark: SparkSession, base: str) -> DataFrame:
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "scored-stream")
    rows = views.accounts(spark, base).select("customerID", "tenure", "Contract", "MonthlyCharges", "InternetService")
    write_features(rows, landing)
    stream = flows.score_stream(flows.stream_files(spark, landing, rows.schema))
    flows.to_files(stream.select("customerID", "Churn_Score", "Risk_Level"), out, scratch_path(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out).withColumn("Churn_Score", F.col("Churn_Score").cast("double"))


@query(
    "stream_alerts",
    f"""WITH {V.PREDICTIONS} SELECT strftime(date_trunc('day', created_at), '%Y-%m-%d') AS day, user_id, count(*) AS alerts FROM predictions WHERE churn_probability >= 0.75 GROUP BY 1, 2""",
)
def stream_alerts(spark: SparkSession, base: str) -> DataFrame:
    out = scratch_path(spark, "alerts")
    schema = views.table(spark, base, "events").schema
    log = views.predictions_of(flows.stream_files(spark, base, schema, glob="events.parquet"))
    flows.upsert_counts(flows.alert_counts(log), out, scratch_path(spark, "offsets")).awaitTermination()
    return flows.latest_counts(spark, out).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "user_id", "alerts")
