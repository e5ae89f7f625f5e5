"""Sources and sinks: write in the shared folder, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import score_by_rules
from ..operators import encode, metrics, profile
from ..session import scratch_path
from ..sources import readers, views, writers
from . import oracle_views as V
from .evaluation import _METRICS
from .registry import query

_ACCOUNT_COLUMNS = ("customerID", "tenure", "Contract", "MonthlyCharges", "InternetService", "TotalCharges", "Churn")
_ACCOUNT_SCHEMA = "customerID string, tenure int, Contract string, MonthlyCharges double, InternetService string, TotalCharges string, Churn string"


def _as_csv(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    # Blank text must come back as blank, not as null.
    df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query(
    "src_csv",
    f"""WITH {V.ACCOUNTS} SELECT "customerID", tenure, "Contract", "MonthlyCharges", "InternetService", total_num IS NULL AS total_is_blank, "Churn" FROM accounts""",
)
def src_csv(spark: SparkSession, base: str) -> DataFrame:
    path = _as_csv(views.accounts(spark, base).select(*_ACCOUNT_COLUMNS), "accounts-csv")
    df = readers.read_csv(spark, path, _ACCOUNT_SCHEMA)
    return df.withColumn("total_is_blank", F.trim("TotalCharges") == "").drop("TotalCharges")


@query(
    "src_cleaned",
    f"""WITH {V.ACCOUNTS} SELECT "customerID", tenure, ("Contract" = 'One year')::INTEGER::DOUBLE AS "Contract_One year", ("Contract" = 'Two year')::INTEGER::DOUBLE AS "Contract_Two year" FROM accounts""",
)
def src_cleaned(spark: SparkSession, base: str) -> DataFrame:
    df = views.accounts(spark, base).select("customerID", "tenure", "Contract")
    path = scratch_path(spark, "features")
    writers.write_features(encode.onehot_encode(df, profile.levels(df, ["Contract"])), path)
    return readers.read_cleaned(spark, path)


@query("snk_features", f"""WITH {V.ACCOUNTS} SELECT "Contract", count(*) AS n, sum(tenure)::BIGINT AS tenure FROM accounts GROUP BY 1""")
def snk_features(spark: SparkSession, base: str) -> DataFrame:
    path = scratch_path(spark, "features")
    writers.write_features(views.accounts(spark, base).select("customerID", "tenure", "Contract"), path)
    return spark.read.parquet(path).groupBy("Contract").agg(F.count("*").alias("n"), F.sum("tenure").alias("tenure"))


@query(
    "src_upload_bulk",
    f"""WITH {V.PREDICTIONS} SELECT CASE WHEN id % 50 = 0 THEN 'quarantined' ELSE 'good' END AS kind, count(*) AS n, sum(CASE WHEN id % 50 = 0 THEN 0 ELSE id % 72 END)::BIGINT AS tenure FROM predictions GROUP BY 1""",
)
def src_upload_bulk(spark: SparkSession, base: str) -> DataFrame:
    """A landing folder in which every fiftieth line is malformed."""
    ids = views.table(spark, base, "events").select(F.col("event_id").alias("id"))
    bad = F.concat(F.lit("bad-"), F.col("id").cast("string"), F.lit(",not a number,x"))
    good = F.concat_ws(",", F.col("id").cast("string"), (F.col("id") % 72).cast("string"), F.lit("One year"))
    path = scratch_path(spark, "landing")
    # The reader expects a header in every file, so the file's first line is given one.
    lines = ids.select(F.when(F.col("id") % 50 == 0, bad).otherwise(good).alias("id,tenure,contract"))
    lines.write.option("header", True).option("quote", "").option("escapeQuotes", False).option("sep", "\u0001").csv(path)
    kept, bad_lines = readers.read_bulk_upload(spark, path, "id bigint, tenure int, contract string")
    counted = kept.agg(F.lit("good").alias("kind"), F.count("*").alias("n"), F.coalesce(F.sum("tenure"), F.lit(0)).alias("tenure"))
    return counted.unionByName(bad_lines.agg(F.lit("quarantined").alias("kind"), F.count("*").alias("n"), F.lit(0).cast("bigint").alias("tenure")))


@query("src_upload_train", f"""WITH {V.ACCOUNTS} SELECT "customerID", tenure, "Churn" FROM accounts""")
def src_upload_train(spark: SparkSession, base: str) -> DataFrame:
    path = _as_csv(views.accounts(spark, base).select("customerID", "tenure", "Churn"), "training-csv")
    return readers.read_training_upload(spark, path, "Churn", "customerID string, tenure int, Churn string")


@query(
    "src_metrics",
    f"""WITH {V.BY_MODEL}, {_METRICS} SELECT model, accuracy, "precision", recall, f1 FROM binary_metrics""",
)
def src_metrics(spark: SparkSession, base: str) -> DataFrame:
    path = scratch_path(spark, "metrics")
    table = metrics.binary_metrics(views.predictions_by_model(spark, base), by=["model"])
    writers.write_metrics(table.select("model", "accuracy", "precision", "recall", "f1"), path)
    return readers.read_metrics(spark, path, "model string, accuracy double, precision double, recall double, f1 double")


@query(
    "snk_metrics",
    f"""WITH {V.BY_MODEL}, {_METRICS} SELECT count(*) AS models, max(accuracy) AS best FROM binary_metrics""",
)
def snk_metrics(spark: SparkSession, base: str) -> DataFrame:
    return src_metrics(spark, base).agg(F.count("*").alias("models"), F.max("accuracy").alias("best"))


@query(
    "snk_scored",
    f"""WITH {V.ACCOUNTS}, {V.RULE_SCORE}, t AS (SELECT CASE WHEN score > 0.65 THEN 'High' WHEN score > 0.4 THEN 'Medium' ELSE 'Low' END AS "Risk_Level", score FROM scored)
    SELECT "Risk_Level", count(*) AS n, min(score)::DOUBLE AS lowest, max(score)::DOUBLE AS highest FROM t GROUP BY 1""",
)
def snk_scored(spark: SparkSession, base: str) -> DataFrame:
    path = scratch_path(spark, "scored")
    scored = score_by_rules(views.accounts(spark, base)).select("customerID", "Churn_Score", "Churn_Prediction", "Risk_Level")
    writers.write_scored(scored, path, partition_by=["Risk_Level"])
    back = spark.read.parquet(path)
    score = F.col("Churn_Score").cast("double")
    return back.groupBy("Risk_Level").agg(F.count("*").alias("n"), F.min(score).alias("lowest"), F.max(score).alias("highest"))
