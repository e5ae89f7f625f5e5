"""Splits, folds and classifier metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, split
from ..sources import views
from . import oracle_views as V
from .registry import query

_U32 = "('0x' || substr(md5({key} || '|{seed}'), 1, 8))::UBIGINT"
_U60 = "('0x' || substr(md5({key} || '|{seed}'), 1, 15))::UBIGINT"


@query(
    "stratified_split",
    f"""WITH {V.ACCOUNTS} SELECT "Churn", {_U32.format(key='"customerID"', seed=42)} / 4294967296.0::DOUBLE < 0.2 AS is_test, count(*) AS n FROM accounts GROUP BY 1, 2""",
)
def stratified_split(spark: SparkSession, base: str) -> DataFrame:
    df = views.accounts(spark, base).select("customerID", "Churn")
    return split.split_counts(split.stratified_split(df, "customerID", "Churn", 0.2, 42, exact=False), "Churn")


@query(
    "stratified_split_exact",
    f"""WITH {V.ACCOUNTS}, h AS (SELECT "customerID", "Churn", {_U60.format(key='"customerID"', seed=42)} AS h FROM accounts),
      r AS (SELECT *, row_number() OVER (PARTITION BY "Churn" ORDER BY h) AS r, count(*) OVER (PARTITION BY "Churn") AS n FROM h),
      c AS (SELECT "Churn", max(h) AS cut FROM r WHERE r <= floor(n * 0.2 + 0.5) GROUP BY 1)
    SELECT "customerID", h."Churn", h <= cut AS is_test FROM h JOIN c ON c."Churn" = h."Churn" """,
)
def stratified_split_exact(spark: SparkSession, base: str) -> DataFrame:
    df = views.accounts(spark, base).select("customerID", "Churn")
    return split.stratified_split(df, "customerID", "Churn", 0.2, 42, exact=True)


@query(
    "kfold_assign",
    f"""WITH {V.ACCOUNTS} SELECT "Churn", floor({_U32.format(key='"customerID"', seed='fold42')} / 4294967296.0::DOUBLE * 5)::INTEGER AS fold, count(*) AS n FROM accounts GROUP BY 1, 2""",
)
def kfold_assign(spark: SparkSession, base: str) -> DataFrame:
    df = split.kfold_assign(views.accounts(spark, base).select("customerID", "Churn"), "customerID", 5, 42)
    return df.groupBy("Churn", "fold").agg(F.count("*").alias("n"))


@query(
    "kfold_assign_exact",
    f"""WITH {V.ACCOUNTS}, h AS (SELECT "customerID", "Churn", {_U60.format(key='"customerID"', seed='fold42')} AS h FROM accounts),
      r AS (SELECT *, row_number() OVER (PARTITION BY "Churn" ORDER BY h) AS r, count(*) OVER (PARTITION BY "Churn") AS n FROM h)
    SELECT "customerID", "Churn", ((r > n * 1 // 3)::INTEGER + (r > n * 2 // 3)::INTEGER) AS fold FROM r""",
)
def kfold_assign_exact(spark: SparkSession, base: str) -> DataFrame:
    df = views.accounts(spark, base).select("customerID", "Churn")
    return split.kfold_assign(df, "customerID", 3, 42, label="Churn", exact=True)


_CONFUSION = """count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 0 AND pred = 1) AS fp,
  count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 1 AND pred = 1) AS tp"""


@query("confusion_matrix", f"WITH {V.BY_MODEL} SELECT model, {_CONFUSION} FROM predictions_by_model GROUP BY 1")
def confusion_matrix(spark: SparkSession, base: str) -> DataFrame:
    return metrics.confusion_matrix(views.predictions_by_model(spark, base), by=["model"])


_METRICS = f"""m AS (SELECT model, {_CONFUSION} FROM predictions_by_model GROUP BY 1),
  binary_metrics AS (SELECT model, round_even((tn + tp)::DOUBLE / (tn + fp + fn + tp) * 100, 1) AS accuracy,
    round_even(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END * 100, 1) AS "precision",
    round_even(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END * 100, 1) AS recall,
    round_even(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp::DOUBLE / (2 * tp + fp + fn) END * 100, 1) AS f1 FROM m)"""


@query("binary_metrics", f"WITH {V.BY_MODEL}, {_METRICS} SELECT * FROM binary_metrics")
def binary_metrics(spark: SparkSession, base: str) -> DataFrame:
    return metrics.binary_metrics(views.predictions_by_model(spark, base), by=["model"])


@query(
    "classification_report",
    f"""WITH {V.BY_MODEL}, m AS (SELECT model, {_CONFUSION} FROM predictions_by_model GROUP BY 1),
      c AS (SELECT model, tn::DOUBLE / (tn + fn) AS p0, tn::DOUBLE / (tn + fp) AS r0, 2 * tn::DOUBLE / (2 * tn + fn + fp) AS f0, tn + fp AS s0,
        tp::DOUBLE / (tp + fp) AS p1, tp::DOUBLE / (tp + fn) AS r1, 2 * tp::DOUBLE / (2 * tp + fn + fp) AS f1, fn + tp AS s1, (tn + tp)::DOUBLE / (tn + fp + fn + tp) AS acc FROM m)
    SELECT model, "class", round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM (
      SELECT model, 'Stay' AS "class", p0 AS "precision", r0 AS recall, f0 AS f1, s0 AS support FROM c UNION ALL SELECT model, 'Churn', p1, r1, f1, s1 FROM c
      UNION ALL SELECT model, 'accuracy', acc, acc, acc, s0 + s1 FROM c UNION ALL SELECT model, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM c
      UNION ALL SELECT model, 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1), (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM c) t""",
)
def classification_report(spark: SparkSession, base: str) -> DataFrame:
    report = metrics.classification_report(views.predictions_by_model(spark, base), by=["model"])
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


_AUC = """s AS (SELECT model, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM predictions_by_model GROUP BY 1, 2),
  w AS (SELECT model, pos, neg, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s),
  auc AS (SELECT model, sum(pos * (below::DOUBLE + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) AS auc FROM w GROUP BY 1)"""


@query("roc_auc", f"WITH {V.BY_MODEL}, {_AUC} SELECT model, round(auc, 9) AS auc FROM auc")
def roc_auc(spark: SparkSession, base: str) -> DataFrame:
    return metrics.roc_auc(views.predictions_by_model(spark, base), by=["model"]).withColumn("auc", F.round("auc", 9))


@query(
    "compare_models",
    f"""WITH {V.BY_MODEL}, {_METRICS}, {_AUC} SELECT b.*, round_even(auc * 100, 1) AS auc FROM binary_metrics b JOIN auc USING (model)""",
)
def compare_models(spark: SparkSession, base: str) -> DataFrame:
    return metrics.compare_models(views.predictions_by_model(spark, base))


@query(
    "argmax_model",
    f"""WITH {V.BY_MODEL}, {_METRICS}, {_AUC} SELECT b.*, round_even(auc * 100, 1) AS auc FROM binary_metrics b JOIN auc USING (model) ORDER BY auc DESC, model LIMIT 1""",
)
def argmax_model(spark: SparkSession, base: str) -> DataFrame:
    return metrics.argmax_model(metrics.compare_models(views.predictions_by_model(spark, base)))


@query(
    "highlight_max",
    f"""WITH {V.BY_MODEL}, {_METRICS} SELECT *, accuracy = max(accuracy) OVER () AS accuracy_is_max, recall = max(recall) OVER () AS recall_is_max FROM binary_metrics""",
)
def highlight_max(spark: SparkSession, base: str) -> DataFrame:
    return metrics.highlight_max(metrics.binary_metrics(views.predictions_by_model(spark, base), by=["model"]), ["accuracy", "recall"])


_FOLDED = _U32.format(key="id", seed="fold42")


@query(
    "cv_summary",
    f"""WITH {V.SCORES}, f AS (SELECT floor({_FOLDED} / 4294967296.0::DOUBLE * 5)::INTEGER AS fold, score, label FROM scores),
      s AS (SELECT fold, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM f GROUP BY 1, 2),
      w AS (SELECT fold, pos, neg, coalesce(sum(neg) OVER (PARTITION BY fold ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s),
      a AS (SELECT fold, sum(pos * (below::DOUBLE + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) AS auc FROM w GROUP BY 1)
    SELECT round(avg(auc), 6) AS cv_auc, round(stddev_pop(auc), 6) AS cv_std FROM a""",
)
def cv_summary(spark: SparkSession, base: str) -> DataFrame:
    folded = split.kfold_assign(views.scores(spark, base), "id", 5, 42)
    per_fold = metrics.roc_auc(folded, by=["fold"])
    return metrics.cv_summary(per_fold).withColumns({c: F.round(c, 6) for c in ("cv_auc", "cv_std")})
