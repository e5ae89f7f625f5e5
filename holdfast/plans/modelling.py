"""Classifiers, tuning, scoring and model storage on the accounts table.

The label is planted: the rule class with a tenth of the rows flipped by a key hash, so quality is checkable.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import INDUSTRIES
from ..functions.hashing import uniform
from ..functions.risk import prediction_text
from ..functions.rules import rule_score
from ..operators import balance, metrics, models
from ..session import materialised, scratch_path
from ..sources import store, views
from . import oracle_views as V
from .registry import query

KEY = "customerID"
COLUMNS = (KEY, "tenure", "MonthlyCharges", "TotalCharges", "Contract", "InternetService", "PaymentMethod", "SeniorCitizen")


def planted(spark: SparkSession, base: str) -> DataFrame:
    """Accounts with the target `Left` (Yes/No), written once to the shared folder: fitting reads it several times."""
    df = views.accounts(spark, base)
    leaves = (rule_score(df.columns).cast("double") > 0.5) != (uniform(F.col(KEY), "noise") < 0.1)
    table = df.select(*COLUMNS, F.when(leaves, "Yes").otherwise("No").alias("Left"))
    return materialised(table, "planted")


JOB = {"target": "Left", "target_map": {"Yes": 1, "No": 0}, "drop": [KEY], "key": KEY}


def small_boost():
    return models.clf_boost(8, 4, 0.2)


def trained(raw: DataFrame, **options) -> models.Trained:
    options = {"estimator": models.clf_logreg(50), "balance": "weights", **options}
    return models.train_industry(raw, "telecom", **JOB, **options)


def _holdout(spark: SparkSession, base: str, name: str, balance_by: str = "weights") -> DataFrame:
    prep, rows = _prepared(spark, base)
    estimator = models.families(len(prep.features), rows.count())[name]
    return models.compare_families(rows, prep.features, KEY, {name: estimator}, balance_by).drop("model")


def _prepared(spark: SparkSession, base: str):
    prep, rows = models.prepared(planted(spark, base), JOB["target"], JOB["target_map"], JOB["drop"], KEY)
    return prep, materialised(rows, "prepared")


def _register_family(key: str, name: str) -> None:
    @query(key, f"""WITH {V.ACCOUNTS} SELECT count(*) AS n, true AS scored, true AS a_fifth, true AS finds_signal FROM accounts""")
    def run(spark: SparkSession, base: str) -> DataFrame:
        """Facts about the scored hold-out: rows of the table, every score valid, size of the hold-out, AUC on the planted label."""
        raw = views.accounts(spark, base)
        held = materialised(_holdout(spark, base, name), "holdout")
        auc = metrics.roc_auc(held)
        facts = held.agg(F.count("*").alias("h"), F.min(F.col("score").between(0, 1) & F.col("pred").isin(0, 1)).alias("scored"), F.count_distinct("label").alias("k"))
        n = raw.agg(F.count("*").alias("n"))
        fifth = F.abs(F.col("h") - F.col("n") * 0.2) <= F.col("k")
        return facts.select("*", n.scalar().alias("n"), auc.select("auc").scalar().alias("auc")).select("n", "scored", fifth.alias("a_fifth"), (F.col("auc") > 0.75).alias("finds_signal"))


_register_family("clf_logreg", "Logistic Regression")
_register_family("clf_forest", "Random Forest")
_register_family("clf_boost", "Boosted Trees")
_register_family("clf_mlp", "Neural Network")


@query(
    "class_weight",
    f"""WITH {V.ACCOUNTS}, n AS (SELECT "Churn", count(*) AS n FROM accounts GROUP BY 1)
    SELECT "customerID", "Churn", round((SELECT sum(n) FROM n)::DOUBLE / (2 * n.n), 9) AS weight FROM accounts JOIN n USING ("Churn")""",
)
def class_weight(spark: SparkSession, base: str) -> DataFrame:
    df = views.accounts(spark, base).select(KEY, "Churn")
    return balance.class_weight(df, "Churn").withColumn("weight", F.round("weight", 9))


@query(
    "smote",
    f"""WITH {V.ACCOUNTS}, n AS (SELECT count(*) FILTER ("Churn" = 'Yes') AS a, count(*) FILTER ("Churn" = 'No') AS b FROM accounts)
    SELECT 1.0::DOUBLE AS label, false AS synthetic, a AS n FROM n UNION ALL SELECT 0.0, false, b FROM n UNION ALL SELECT 1.0, true, b - a FROM n""",
)
def smote(spark: SparkSession, base: str) -> DataFrame:
    df = views.accounts(spark, base).withColumn("label", F.when(F.col("Churn") == "Yes", 1.0).otherwise(0.0))
    prep, encoded = models.prepared(df.drop("label"), "Churn", JOB["target_map"], [], KEY)
    rows = balance.smote(encoded, prep.features, KEY)
    return rows.groupBy("label", "synthetic").agg(F.count("*").alias("n"))


@query(
    "smote_rows",
    f"""WITH {V.CLIENTS}, n AS (SELECT count(*) FILTER ("Exited" = 1) AS a, count(*) FILTER ("Exited" = 0) AS b FROM clients)
    SELECT false AS synthetic, a + b AS n, true AS within FROM n UNION ALL SELECT true, abs(a - b), true FROM n WHERE a <> b""",
)
def smote_rows(spark: SparkSession, base: str) -> DataFrame:
    """Real and synthetic rows: how many, and whether every value lies within the range of the real rows."""
    columns = ["CreditScore", "Age", "Balance", "Tenure"]
    df = views.clients(spark, base).withColumn("label", F.col("Exited").cast("double"))
    rows = materialised(balance.smote(df, columns, "CustomerId"), "smote")
    real = rows.filter(~F.col("synthetic")).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    inside = F.lit(True)
    for c in columns:
        inside = inside & F.col(c).between(real[f"lo_{c}"], real[f"hi_{c}"])
    return rows.groupBy("synthetic").agg(F.count("*").alias("n"), F.min(inside).alias("within"))


@query("grid_search", "SELECT 12 AS points, 6 AS longer_rounds_fitted, true AS searched")
def grid_search(spark: SparkSession, base: str) -> DataFrame:
    """Twelve combinations over three folds; the short ones of each depth and rate are the first rounds of the long ones."""
    prep, rows = models.prepared(planted(spark, base), JOB["target"], JOB["target_map"], JOB["drop"], KEY)
    train = rows.filter(~F.col("is_test")).drop("is_test")
    table, best = models.grid_search(models.clf_boost(), models.TUNING_GRID, train, prep.features, KEY, balance="weights", parallelism=4)
    chosen = F.max_by("parameters", F.struct("mean_auc", -F.col("point"))) == str(sorted(best.items()))
    longest = F.count_if(F.col("parameters").contains(f"('maxIter', {max(models.TUNING_GRID['maxIter'])})")).cast("int")
    return table.agg(F.count("*").cast("int").alias("points"), longest.alias("longer_rounds_fitted"), (chosen & (F.min("mean_auc") > 0.7)).alias("searched"))


@query(
    "train_on_smote",
    f"""WITH {V.ACCOUNTS}, n AS (SELECT count(*) AS n FROM accounts) SELECT n AS n, true AS a_fifth, true AS balanced, true AS finds_signal FROM n""",
)
def train_on_smote(spark: SparkSession, base: str) -> DataFrame:
    """The main path: encode, split, SMOTE on the training rows only, fit on the full matrix, measure on untouched rows."""
    prep, rows = _prepared(spark, base)
    train, test = rows.filter(~F.col("is_test")).drop("is_test"), rows.filter("is_test")
    made = materialised(balance.smote(train, prep.features, KEY), "smote")
    model = models.fitted(models.clf_logreg(), made, prep.features, KEY, None)
    held = materialised(models.with_scores(model, test, [KEY, "label"]), "holdout")
    mass = made.agg((F.count_if(F.col("label") == 1) == F.count_if(F.col("label") == 0)).alias("balanced"))
    auc = metrics.roc_auc(held)
    facts = held.agg(F.count("*").alias("h"), F.count_distinct("label").alias("k"))
    n = rows.agg(F.count("*").alias("n"))
    facts = facts.select("*", n.scalar().alias("n"), auc.select("auc").scalar().alias("auc"), mass.scalar().alias("balanced"))
    fifth = F.abs(F.col("h") - F.col("n") * 0.2) <= F.col("k")
    return facts.select("n", fifth.alias("a_fifth"), "balanced", (F.col("auc") > 0.75).alias("finds_signal"))


@query("cross_val", "SELECT unnest(range(5))::INTEGER AS fold, true AS finds_signal")
def cross_val(spark: SparkSession, base: str) -> DataFrame:
    prep, rows = models.prepared(planted(spark, base), JOB["target"], JOB["target_map"], JOB["drop"], KEY, fit_on="all")
    return models.cross_val(models.clf_logreg(50), rows.drop("is_test"), prep.features, KEY, 5, parallelism=4).select("fold", (F.col("auc") > 0.75).alias("finds_signal"))


@query(
    "train_industry",
    f"""WITH {V.ACCOUNTS}, {V.CLIENTS}, {V.SHOPPERS} SELECT 'telecom' AS industry, count(*) AS customers, NULL AS failed FROM accounts
    UNION ALL SELECT 'banking', count(*), NULL FROM clients UNION ALL SELECT 'ecommerce', count(*), NULL FROM shoppers UNION ALL SELECT 'broken', 0, true""",
)
def train_industry(spark: SparkSession, base: str) -> DataFrame:
    """Three industries; the job whose key column is missing fails without stopping the rest."""
    bank = views.clients(spark, base).drop("Segment", "Surname")
    shop = views.shoppers(spark, base)
    common = {"estimator": models.clf_logreg(50), "balance": "weights"}
    done, failed = models.train_industries(
        {
            "telecom": {"raw": planted(spark, base), **JOB, **common},
            "banking": {"raw": bank, "target": "Exited", "target_map": None, "drop": ["CustomerId"], "key": "CustomerId", **common},
            "ecommerce": {"raw": shop, "target": "Churn", "target_map": None, "drop": ["CustomerID"], "key": "CustomerID", **common},
            "broken": {"raw": shop, "target": "Churn", "target_map": None, "drop": [], "key": "absent", **common},
        }
    )
    results = models.union_metrics(done).select("industry", "customers", F.lit(None).cast("boolean").alias("failed"))
    errors = spark.createDataFrame([(k, 0, True) for k in failed], "industry string, customers bigint, failed boolean")
    return results.unionByName(errors)


@query("compare_families", "SELECT unnest(['Boosted Trees', 'Logistic Regression', 'Neural Network', 'Random Forest']) AS model, true AS finds_signal")
def compare_families(spark: SparkSession, base: str) -> DataFrame:
    """All four families."""
    prep, rows = _prepared(spark, base)
    fams = models.families(len(prep.features), rows.count(), small=True)
    table = metrics.compare_models(materialised(models.compare_families(rows, prep.features, KEY, fams, "weights"), "compared"))
    return table.select("model", (F.col("auc") > 75).alias("finds_signal"))


@query("score_table", f"""WITH {V.ACCOUNTS} SELECT "customerID", true AS complete FROM accounts""")
def score_table(spark: SparkSession, base: str) -> DataFrame:
    """Every account has a probability, a class and the risk level that belongs to it."""
    raw = planted(spark, base)
    t = trained(raw)
    scored = models.score_table(t.model, t.prep, raw, [KEY])
    p = F.col("churn_probability")
    fits = (F.col("prediction") == prediction_text((p > 0.5).cast("int"))) | (F.abs(p - 0.5) < 1e-4)
    return scored.select(KEY, F.coalesce(p.between(0, 1) & F.col("risk_level").isNotNull() & fits, F.lit(False)).alias("complete"))


@query("mdl_save_load", f"""WITH {V.ACCOUNTS} SELECT count(*) AS n, 0::BIGINT AS changed FROM accounts""")
def mdl_save_load(spark: SparkSession, base: str) -> DataFrame:
    raw = planted(spark, base)
    t = trained(raw)
    root = scratch_path(spark, "models")
    store.save_model(spark, root, "telecom", "Telecom", t.model, t.prep, {"maxIter": 50})
    model, prep, _ = store.load_model(spark, root, "telecom")
    before, after = models.score_table(t.model, t.prep, raw, [KEY]), models.score_table(model, prep, raw, [KEY])
    tally = lambda df, n: df.groupBy(*df.columns).agg(F.lit(n).alias("side"), F.count("*").alias("n"))
    both = tally(before, 1).unionByName(tally(after, -1)).groupBy(*before.columns).agg(F.sum(F.col("side") * F.col("n")).alias("d"), F.max("n").alias("n"))
    return both.agg(F.sum("n").alias("n"), F.count_if(F.col("d") != 0).alias("changed"))


@query("model_registry", f"SELECT industry, CASE WHEN industry = 'telecom' THEN 'ready' ELSE 'not trained' END AS status FROM (SELECT unnest({list(INDUSTRIES)}) AS industry)")
def model_registry(spark: SparkSession, base: str) -> DataFrame:
    raw = planted(spark, base)
    t = trained(raw)
    root = scratch_path(spark, "models")
    store.save_model(spark, root, "telecom", "Telecom", t.model, t.prep, {"maxIter": 50})
    return store.model_registry(spark, root, list(INDUSTRIES)).select("industry", "status")


def _importance(spark: SparkSession, base: str) -> DataFrame:
    t = trained(planted(spark, base), estimator=small_boost(), balance="none")
    return models.feature_importance(t.model, t.prep.features, spark)


_LEVELS = " UNION ALL ".join(
    f"""SELECT '{c}_' || level AS feature FROM (SELECT DISTINCT "{c}" AS level FROM accounts WHERE "{c}" IS NOT NULL QUALIFY dense_rank() OVER (ORDER BY level) > 1)"""
    for c in ("Contract", "InternetService", "PaymentMethod")
)
_NUMBERS = "SELECT unnest(['tenure', 'MonthlyCharges', 'TotalCharges', 'SeniorCitizen']) AS feature"


@query("feature_importance", f"WITH {V.ACCOUNTS} {_NUMBERS} UNION ALL {_LEVELS}")
def feature_importance(spark: SparkSession, base: str) -> DataFrame:
    """The features of the contract, each with a share of the importance."""
    shares = _importance(spark, base)
    whole = shares.agg(F.abs(F.sum("importance") - 1) < 1e-6).scalar()
    return shares.filter(whole & F.col("importance").between(0, 1)).select("feature")


@query("topk_importance", "SELECT 10 AS n, true AS falling")
def topk_importance(spark: SparkSession, base: str) -> DataFrame:
    """The ten first of the ranking: none that is left out is above one of them."""
    every = materialised(_importance(spark, base), "importance")
    best = models.topk_importance(every, 10)
    rest = every.join(best, "feature", "left_anti").agg(F.coalesce(F.max("importance"), F.lit(0.0))).scalar()
    return best.agg(F.count("*").cast("int").alias("n"), F.min("importance").alias("least")).select("n", (F.col("least") >= rest).alias("falling"))


@query(
    "union_metrics",
    f"""WITH {V.ACCOUNTS} SELECT unnest(['telecom', 'unweighted']) AS industry, (SELECT count(*) FROM accounts) AS customers, unnest([8, 50]) AS best_estimators,
      unnest([4, 0]) AS best_depth, unnest([0.2::DOUBLE, 0.0::DOUBLE]) AS best_lr, unnest([true, false]) AS cross_validated, true AS finds_signal""",
)
def union_metrics(spark: SparkSession, base: str) -> DataFrame:
    raw = planted(spark, base)
    table = models.union_metrics({"telecom": trained(raw, estimator=small_boost(), folds=3), "unweighted": replace(trained(raw, balance="none"), industry="unweighted")})
    validated = (F.col("cv_auc") > 75) & (F.col("cv_std") < 5)
    known = [F.coalesce("best_depth", F.lit(0)).alias("best_depth"), F.coalesce("best_lr", F.lit(0.0)).alias("best_lr"), F.coalesce(validated, F.lit(False)).alias("cross_validated")]
    return table.select("industry", "customers", "best_estimators", *known, (F.col("auc") > 75).alias("finds_signal"))


# Every seventh customer, by a hash of the id, has a text that is no number; so have some of the accounts themselves.
_BROKEN = """(('0x' || substr(md5("customerID" || '|broken'), 1, 8))::UBIGINT / 4294967296.0::DOUBLE < 1.0 / 7 OR total_num IS NULL)"""


def _bulk(spark: SparkSession, base: str) -> DataFrame:
    raw = planted(spark, base)
    t = trained(raw)
    broken = uniform(F.col(KEY), "broken") < 1.0 / 7
    upload = raw.withColumn("TotalCharges", F.when(broken, F.lit("n/a?")).otherwise(F.col("TotalCharges").cast("string")))
    return models.score_or_error(t.model, t.prep, upload, [KEY])


@query("bulk_errors", f"""WITH {V.ACCOUNTS} SELECT "customerID", CASE WHEN {_BROKEN} THEN 'not a number: TotalCharges' END AS error, NOT {_BROKEN} AS scored FROM accounts""")
def bulk_errors(spark: SparkSession, base: str) -> DataFrame:
    """Every row of an upload is scored or has an error."""
    rows = _bulk(spark, base)
    whole = F.col("churn_probability").between(0, 1) & F.col("prediction").isNotNull() & F.col("risk_level").isNotNull()
    return rows.select(KEY, "error", F.coalesce(whole, F.lit(False)).alias("scored"))


@query("bulk_outcome", f"""WITH {V.ACCOUNTS} SELECT count(*) AS total, count(*) FILTER (NOT {_BROKEN}) AS successful, count(*) FILTER ({_BROKEN}) AS failed FROM accounts""")
def bulk_outcome(spark: SparkSession, base: str) -> DataFrame:
    return models.bulk_outcome(_bulk(spark, base)).select("total", "successful", "failed")


