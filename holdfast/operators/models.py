"""Classifier families, tuning, cross-validation and scoring on MLlib."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.risk import prediction_text, risk_label
from ..functions.text import ref
from ..session import materialised, tasks_for
from . import grow, passes
from .balance import class_weight, oversample, smote
from .clean import quarantine
from .encode import Preparation, fit_preparation
from .metrics import argmax_model, compare_models, roc_auc
from .split import kfold_assign, stratified_split

# Parameters of the classifier families and tuning grids.
BOOST_DEFAULTS = {"maxIter": 300, "maxDepth": 5, "stepSize": 0.05}
TUNING_GRID = {"maxIter": [100, 300], "maxDepth": [4, 5, 6], "stepSize": [0.05, 0.1]}
RETRAIN_GRID = {"maxIter": [100, 200], "maxDepth": [4, 5], "stepSize": [0.05, 0.1]}
NETWORK_LAYERS = (64, 32, 16, 2)


def clf_logreg(max_iter: int = 1000, c: float = 1.0, rows: int | None = None, weight: str | None = None) -> LogisticRegression:
    """L2 penalty.  `c` becomes MLlib's per-row penalty by the number of training rows, given here or counted by `fitted`."""
    model = LogisticRegression(maxIter=max_iter, elasticNetParam=0.0, standardization=False)
    return per_row(model.setWeightCol(weight) if weight else model, "regParam", 1.0 / c, rows)


def per_row(estimator: Estimator, name: str, value: float, rows: int | None) -> Estimator:
    """The parameter set to value / rows; without a number of rows, `fitted` does that for the rows it gets."""
    if rows:
        estimator.set(estimator.getParam(name), value / rows)
    else:
        estimator.per_row = (name, value)
    return estimator


def clf_forest(trees: int = 200, depth: int = 10, min_rows: int = 2, seed: int = 42, weight: str | None = None) -> RandomForestClassifier:
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=min_rows, seed=seed, featureSubsetStrategy="sqrt")
    return model.setWeightCol(weight) if weight else model


def clf_boost(
    rounds: int = 300, depth: int = 5, rate: float = 0.05, subsample: float = 0.8, columns: str = "0.8", min_rows: int = 3,
    gamma: float = 0.1, rows: int | None = None, seed: int = 42, weight: str | None = None,
) -> GBTClassifier:
    """`gamma` is the least gain of a split summed over all training rows; MLlib wants it per row, so it is divided by their
    number, given here or counted by `fitted`."""
    model = GBTClassifier(
        maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, featureSubsetStrategy=columns,
        minInstancesPerNode=min_rows, seed=seed,
    )
    return per_row(model.setWeightCol(weight) if weight else model, "minInfoGain", gamma, rows)


def clf_mlp(n_features: int, max_iter: int = 50, layers: Sequence[int] = NETWORK_LAYERS, seed: int = 42) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(layers=[n_features, *layers], maxIter=max_iter, seed=seed, blockSize=128)


def families(n_features: int, rows: int, small: bool = False, weight: str | None = None) -> dict[str, Estimator]:
    """The four compared families for `rows` training rows; `small` keeps trees and iterations few for quick runs."""
    return {
        "Logistic Regression": clf_logreg(100 if small else 1000, rows=rows, weight=weight),
        "Random Forest": clf_forest(20, 6, weight=weight) if small else clf_forest(weight=weight),
        "Boosted Trees": clf_boost(10, 4, 0.1, rows=rows, weight=weight) if small else clf_boost(rows=rows, weight=weight),
        "Neural Network": clf_mlp(n_features, 20 if small else 50),
    }


def fitted(estimator: Estimator, rows: DataFrame, features: Sequence[str], key: str, weight: str | None, label: str = "label") -> PipelineModel:
    """Fit on balanced rows; an estimator that takes no weights gets the smaller classes repeated instead."""
    if weight and estimator.hasParam("weightCol"):
        estimator = estimator.copy({estimator.getParam("weightCol"): weight})
    elif weight:
        rows = oversample(rows, key, label)
    name, value = getattr(estimator, "per_row", (None, None))
    if name:
        estimator = estimator.copy({estimator.getParam(name): value / max(1, rows.count())})
    made = grow.fit(estimator, rows, features, key, weight, label)
    if made is None:
        made = passes.network(estimator, rows, features, key, label)
    if made is not None:
        return PipelineModel([*assembled(features, estimator).getStages()[:-1], made])
    return assembled(features, estimator).fit(rows)


def assembled(features: Sequence[str], estimator: Estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), estimator])


def with_scores(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    out = model.transform(df)
    return out.select(
        *[ref(k) for k in keep], vector_to_array("probability")[1].alias("score"), F.col("prediction").cast("int").alias("pred")
    )


def score_table(model: PipelineModel, prep: Preparation, raw: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Raw records to probability, class and risk: one narrow stage from scan to result."""
    scored = with_scores(model, prep.transform(raw, keep=keep), keep)
    return scored.select(
        *[ref(k) for k in keep],
        F.bround("score", 4).alias("churn_probability"),
        prediction_text(F.col("pred")).alias("prediction"),
        risk_label(F.col("score")).alias("risk_level"),
    )


def rebalance(train: DataFrame, features: Sequence[str], key: str, method: str = "smote", label: str = "label", seed: int = 42) -> tuple[DataFrame, str | None]:
    """(training rows, weight column or None) by the method that the caller chose: "smote", "weights" or "none".

    Only training rows may be passed.  With weights the key column is kept.
    """
    if method == "smote":
        return smote(train, features, key, label, seed=seed), None
    if method == "weights":
        return class_weight(train, label), "weight"
    if method == "none":
        return train, None
    raise ValueError(f"unknown rebalancing {method!r}")


def fold_auc(
    estimator: Estimator, folded: DataFrame, features: Sequence[str], key: str, fold: int, balance: str = "none", label: str = "label"
) -> float | None:
    """AUC of one fold; rebalancing sees that fold's training rows only."""
    train = folded.filter(F.col("fold") != fold)
    test = folded.filter(F.col("fold") == fold)
    rows, weight = rebalance(train, features, key, balance, label)
    model = fitted(estimator, rows, features, key, weight, label)
    scored = with_scores(model, test, [label]).filter(F.col("score").isNotNull())
    return roc_auc(scored, label).first()["auc"]


def cross_val(
    estimator: Estimator, df: DataFrame, features: Sequence[str], key: str, k: int = 5, balance: str = "none", label: str = "label", parallelism: int = 2
) -> DataFrame:
    """(fold, auc) with stratified folds."""
    folded = kfold_assign(df, key, k, label=label, exact=True).persist()
    try:
        with ThreadPoolExecutor(parallelism) as pool:
            found = list(pool.map(lambda i: fold_auc(estimator, folded, features, key, i, balance, label), range(k)))
    finally:
        folded.unpersist()
    return df.sparkSession.createDataFrame([(i, a) for i, a in enumerate(found)], "fold int, auc double")


def prefix_scores(model: PipelineModel, df: DataFrame, features: Sequence[str], keep: Sequence[str], rounds: Sequence[int]) -> DataFrame:
    """`keep` and, for each number of rounds m, the probability `score_m` of the model's first m trees."""
    from .explain import tree_arrays

    trees = tree_arrays(model)
    wanted = sorted(set(rounds))
    if wanted[0] < 1 or wanted[-1] > len(trees):
        raise ValueError(f"{len(trees)} rounds were fitted, asked for {wanted}")
    n = len(features)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        arrays = [{c: np.array(t[c]) for c in ("left", "right", "feature", "cut", "value")} | {"weight": t["weight"]} for t in trees[: wanted[-1]]]
        for batch in batches:
            x = np.stack([batch.column(f"__f{i}").to_numpy(zero_copy_only=False) for i in range(n)], axis=1) if batch.num_rows else np.empty((0, n))
            margin, scores = np.zeros(len(x)), []
            for number, t in enumerate(arrays, 1):
                node = np.zeros(len(x), dtype=np.int64)
                inner = np.flatnonzero(t["left"][node] >= 0)
                while len(inner):
                    at = node[inner]
                    node[inner] = np.where(x[inner, t["feature"][at]] <= t["cut"][at], t["left"][at], t["right"][at])
                    inner = inner[t["left"][node[inner]] >= 0]
                margin += t["weight"] * t["value"][node]
                if number in wanted:
                    scores.append(pa.array(1 / (1 + np.exp(-margin))))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *scores], names=[*keep, *[f"score_{m}" for m in wanted]])

    inputs = df.select(*[ref(c) for c in keep], *[ref(f).cast("double").alias(f"__f{i}") for i, f in enumerate(features)])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[ref(c) for c in keep]).schema]
    return inputs.mapInArrow(run, ", ".join([*fields, *[f"score_{m} double" for m in wanted]]))


def grid_points(grid: Mapping[str, Iterable]) -> list[dict]:
    names = list(grid)
    return [dict(zip(names, values)) for values in itertools.product(*grid.values())]


def grid_search(
    base: Estimator, grid: Mapping[str, Iterable], df: DataFrame, features: Sequence[str], key: str, k: int = 3, balance: str = "none",
    label: str = "label", parallelism: int = 2,
) -> tuple[DataFrame, dict]:
    """All combinations by mean fold AUC: (table of results, best parameters).  First combination wins ties.

    The fits of all combinations and folds are independent Spark jobs, a few of which run at a time.  Boosting adds tree after
    tree, so of combinations that differ in the number of rounds only the longest is fitted: its first rounds are the others.
    """
    points = grid_points(grid)
    # fits by what they share: {other parameters: [(point, rounds)]}
    fits: dict[tuple, list[tuple[int, int | None]]] = {}
    for p, point in enumerate(points):
        rounds = point.get("maxIter") if isinstance(base, GBTClassifier) else None
        rest = tuple(sorted((n, v) for n, v in point.items() if rounds is None or n != "maxIter"))
        fits.setdefault(rest, []).append((p, rounds))
    folded = kfold_assign(df, key, k, label=label, exact=True).persist()
    parts: dict[int, DataFrame] = {}
    aucs: dict[tuple[int, int], float | None] = {}
    try:
        for i in range(k):
            rows, weight = rebalance(folded.filter(F.col("fold") != i), features, key, balance, label)
            parts[i] = rows.persist()

        def one(job: tuple[tuple, int]) -> None:
            rest, i = job
            wanted = fits[rest]
            chosen = dict(rest) | ({"maxIter": max(m for _, m in wanted)} if wanted[0][1] is not None else {})
            est = base.copy({base.getParam(n): v for n, v in chosen.items()})
            model = fitted(est, parts[i], features, key, "weight" if "weight" in parts[i].columns else None, label)
            test = folded.filter(F.col("fold") == i)
            if len(wanted) == 1:
                aucs[(wanted[0][0], i)] = roc_auc(with_scores(model, test, [label]), label).first()["auc"]
                return
            scored = prefix_scores(model, test, features, [label], [m for _, m in wanted]).persist()
            for p, m in wanted:
                aucs[(p, i)] = roc_auc(scored.select(ref(label), F.col(f"score_{m}").alias("score")), label).first()["auc"]
            scored.unpersist()

        jobs = [(rest, i) for rest in fits for i in range(k)]
        with ThreadPoolExecutor(parallelism) as pool:
            list(pool.map(one, jobs))
    finally:
        folded.unpersist()
        for rows in parts.values():
            rows.unpersist()
    table = []
    for p, point in enumerate(points):
        values = [aucs[(p, i)] for i in range(k) if aucs[(p, i)] is not None]
        table.append((p, str(sorted(point.items())), sum(values) / len(values) if values else None))
    best = max((row for row in table if row[2] is not None), key=lambda row: (row[2], -row[0]))[0]
    return df.sparkSession.createDataFrame(table, "point int, parameters string, mean_auc double"), points[best]


@dataclass
class Trained:
    """A model with the preparation it was trained behind, its scored hold-out rows and its parameters."""

    industry: str
    prep: Preparation
    model: PipelineModel
    holdout: DataFrame
    params: dict
    rows: int
    estimator: Estimator | None = None
    folds: DataFrame | None = None

    def metrics(self) -> DataFrame:
        return compare_models(self.holdout.withColumn("model", F.lit(self.industry)))


def prepared(
    raw: DataFrame, target: str, target_map: Mapping[str, int] | None, drop: Sequence[str], key: str, fit_on: str = "train", test_size: float = 0.2
) -> tuple[Preparation, DataFrame]:
    """Clean, split and encode: rows with `label`, the key, `is_test` and the features.

    `fit_on="train"` learns medians, levels and scaling from training rows; "all" from all rows.
    """
    from .clean import drop_null_target, map_target, numeric_columns, text_columns

    clean = drop_null_target(map_target(raw, target, target_map), target)
    used = [c for c in clean.columns if c not in set(drop)]
    kept = {key, target, *numeric_columns(clean, used), *text_columns(clean, used)}
    # read by the fit and by the result, and counted
    clean = materialised(stratified_split(clean.select(*[ref(c) for c in clean.columns if c in kept]), key, target, test_size), "split")
    source = clean if fit_on == "all" else clean.filter(~F.col("is_test"))
    prep = fit_preparation(source.drop("is_test"), target=target, drop=[*drop, key])
    rows = prep.transform(clean.withColumn("label", ref(target).cast("double")), keep=[key, "label", "is_test"])
    return prep, spread(rows, key, clean.count())


def spread(rows: DataFrame, key: str, count: int) -> DataFrame:
    """Iterative fits use as many tasks as there are partitions.  Hashing the key places rows the same way on every
    recomputation; `count`, the number of rows, decides how many partitions, so tasks stay even, many and small."""
    return rows.repartition(tasks_for(count), ref(key))


def train_industry(
    raw: DataFrame, industry: str, target: str, target_map: Mapping[str, int] | None, drop: Sequence[str], key: str,
    estimator: Estimator | None = None, grid: Mapping[str, Iterable] | None = None, balance: str = "smote", fit_on: str = "train",
    test_size: float = 0.2, folds: int = 0,
) -> Trained:
    """One industry end to end; with a grid the best combination is refitted on all training rows, and with `folds` the
    chosen parameters are cross-validated on all rows.  The scored hold-out is written, so later reads fit nothing."""
    prep, rows = prepared(raw, target, target_map, drop, key, fit_on, test_size)
    rows = rows.persist()
    try:
        train, test = rows.filter(~F.col("is_test")), rows.filter("is_test")
        count = rows.count()
        est = estimator or clf_boost(rows=count)
        params: dict = {}
        if grid:
            _, params = grid_search(est, grid, train.drop("is_test"), prep.features, key, balance=balance)
            est = est.copy({est.getParam(n): v for n, v in params.items()})
        balanced, weight = rebalance(train.drop("is_test"), prep.features, key, balance)
        model = fitted(est, balanced, prep.features, key, weight)
        holdout = materialised(with_scores(model, test, [key, "label"]), "holdout")
        scores = cross_val(est, rows.drop("is_test"), prep.features, key, folds, balance) if folds else None
        return Trained(industry, prep, model, holdout, params, count, est, scores)
    finally:
        rows.unpersist()


def train_industries(jobs: Mapping[str, Mapping]) -> tuple[dict[str, Trained], dict[str, str]]:
    """Every job in turn; an error in one is recorded and does not stop the others."""
    done, failed = {}, {}
    for name, job in jobs.items():
        try:
            done[name] = train_industry(industry=name, **job)
        except Exception as error:  # noqa: BLE001 - reported to the caller
            failed[name] = f"{type(error).__name__}: {error}"
    return done, failed


def compare_families(rows: DataFrame, features: Sequence[str], key: str, estimators: Mapping[str, Estimator], balance: str = "none") -> DataFrame:
    """Fit each family on the training side and stack the scored hold-out rows as (model, key, label, score, pred)."""
    train, test = rows.filter(~F.col("is_test")).drop("is_test"), rows.filter("is_test")
    balanced, weight = rebalance(train, features, key, balance)
    if key in balanced.columns:
        # tables that are read back come in parts of uneven size, one more than there are cores
        balanced = spread(balanced, key, train.count())
    balanced = balanced.persist()
    out: DataFrame | None = None
    for name, est in estimators.items():
        model = fitted(est, balanced, features, key, weight)
        scored = with_scores(model, test, [key, "label"]).withColumn("model", F.lit(name))
        out = scored if out is None else out.unionByName(scored)
    balanced.unpersist()
    return out


def feature_importance(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Impurity importance per feature; the list is as long as the feature contract."""
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")


def topk_importance(importance: DataFrame, k: int = 10) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), "feature").limit(k)


def cv_scores_summary(folds: DataFrame) -> DataFrame:
    from .metrics import cv_summary

    return cv_summary(folds).select(F.bround(F.col("cv_auc") * 100, 1).alias("cv_auc"), F.bround(F.col("cv_std") * 100, 2).alias("cv_std"))


def union_metrics(trained: Mapping[str, Trained]) -> DataFrame:
    """One row per industry: rows, features, the five hold-out metrics, the cross-validated AUC and the parameters chosen."""
    out: DataFrame | None = None
    for t in trained.values():
        chosen = {n: t.estimator.getOrDefault(n) if t.estimator is not None and t.estimator.hasParam(n) else None for n in ("maxIter", "maxDepth", "stepSize")}
        line = t.metrics().withColumnsRenamed({"model": "industry"}).withColumns(
            {
                "customers": F.lit(t.rows).cast("bigint"),
                "features": F.lit(len(t.prep.features)),
                "best_estimators": F.lit(chosen["maxIter"]).cast("int"),
                "best_depth": F.lit(chosen["maxDepth"]).cast("int"),
                "best_lr": F.lit(chosen["stepSize"]).cast("double"),
            }
        )
        if t.folds is None:
            line = line.withColumns({c: F.lit(None).cast("double") for c in ("cv_auc", "cv_std")})
        else:
            scores = cv_scores_summary(t.folds).first()
            line = line.withColumns({c: F.lit(scores[c]).cast("double") for c in ("cv_auc", "cv_std")})
        out = line if out is None else out.unionByName(line)
    return out


def keep_best(trained: Mapping[str, Trained], by: str = "auc") -> Trained:
    """The model with the best hold-out metric, first by name on ties; what a caller stores."""
    table = union_metrics(trained)
    return trained[argmax_model(table, by, "industry").first()["industry"]]


def score_or_error(model: PipelineModel, prep: Preparation, raw: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Bulk scoring with a result or an error for every row, in one narrow stage: `error` names the first numeric feature
    whose text is no number; such a row has no probability, prediction or risk."""
    present = [f for f in prep.numeric if f in raw.columns]
    checked = quarantine(raw, present)
    safe = checked.withColumns({f: F.when(F.col("error").isNull(), ref(f)) for f in present if f not in keep})
    scored = score_table(model, prep, safe, [*keep, "error"])
    results = ("churn_probability", "prediction", "risk_level")
    return scored.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in results})


def bulk_outcome(scored: DataFrame) -> DataFrame:
    """Totals of a bulk scoring: rows, scored, failed, churners and their share of the scored rows in percent."""
    churn = F.count_if(F.col("prediction") == prediction_text(F.lit(1)))
    ok = F.count_if(F.col("error").isNull())
    share = F.bround(F.try_divide(churn * 100.0, ok), 1)
    return scored.agg(F.count("*").alias("total"), ok.alias("successful"), F.count_if(F.col("error").isNotNull()).alias("failed"), churn.alias("churn"), share.alias("churn_pct"))
