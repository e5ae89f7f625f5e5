"""Trees grown from histograms against MLlib's own, whatever the number of tasks; and the sizes of what is fitted."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast import session
from holdfast.functions.hashing import uniform
from holdfast.operators import gang, grow, metrics, models, passes, segments
from holdfast.plans import modelling

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """Few values per feature, so that MLlib and histograms know the same splits; some rows weigh more."""
    u = [uniform(F.col("id").cast("string"), s) for s in "abcn"]
    df = spark.range(1200).select(F.col("id").cast("string").alias("id"), F.floor(u[0] * 9).alias("a"), F.floor(u[1] * 7).alias("b"), F.floor(u[2] * 2).alias("c"), u[3].alias("n"))
    y = ((F.col("a") + F.col("b") + F.col("c") > 8) != (F.col("n") < 0.1)).cast("double")
    return df.withColumn("label", y).withColumn("weight", F.lit(1.0) + y).drop("n").persist()


def scores(model, rows):
    return models.with_scores(model, rows, ["id"]).toPandas().set_index("id").sort_index()["score"].to_numpy()


@pytest.mark.parametrize("weight", [None, "weight"])
def test_boosted_trees_equal_mllib_without_sampling(spark, rows, weight):
    est = models.clf_boost(6, 3, 0.2, subsample=1.0, columns="all", rows=1200)
    got = models.fitted(est, rows, FEATURES, "id", weight)
    want = models.assembled(FEATURES, est.copy({est.weightCol: weight}) if weight else est).fit(rows)
    assert scores(got, rows) == pytest.approx(scores(want, rows), abs=1e-9)
    own, mllib = got.stages[-1], want.stages[-1]
    assert own.featureImportances.toArray() == pytest.approx(mllib.featureImportances.toArray(), abs=1e-9)
    assert own.treeWeights == mllib.treeWeights and own.totalNumNodes == mllib.totalNumNodes and own.getMaxDepth() == 3


@pytest.mark.parametrize("made", [lambda: models.clf_boost(5, 3, 0.2), lambda: models.clf_forest(8, 5)], ids=["boost", "forest"])
def test_trees_do_not_depend_on_the_number_of_tasks(spark, rows, made, monkeypatch):
    est = made()
    alone = scores(models.fitted(est, rows, FEATURES, "id", "weight"), rows)
    monkeypatch.setattr(session, "ROWS_PER_TASK", 400)
    assert gang.tasks(spark, 1200) == 3
    assert scores(models.fitted(est, rows.repartition(5), FEATURES, "id", "weight"), rows) == pytest.approx(alone, abs=1e-9)


def test_a_fit_is_a_few_jobs_however_many_trees(spark, rows):
    def jobs(est):
        sc = spark.sparkContext
        group = f"fit of {est.getMaxIter()}"
        sc.setJobGroup(group, group)
        model = models.fitted(est, rows, FEATURES, "id", None)
        found = len(sc.statusTracker().getJobIdsForGroup(group))
        sc.setJobGroup("none", "none")
        return model, found

    few, many = (jobs(models.clf_boost(n, 2, 0.2, rows=1200)) for n in (2, 40))
    assert many[1] == few[1] < 30 and many[0].stages[-1].getNumTrees == 40


def test_what_mllib_has_to_fit_is_left_to_it(spark, rows):
    three = rows.withColumn("label", F.pmod(F.col("id").cast("int"), F.lit(3)).cast("double"))
    assert grow.fit(models.clf_forest(2, 2), three, FEATURES, "id", None, "label") is None
    assert grow.fit(models.clf_logreg(5), rows, FEATURES, "id", None, "label") is None
    with pytest.raises(Exception, match="null or NaN"):
        models.fitted(models.clf_forest(2, 2), rows.withColumn("a", F.when(F.col("a") > 1, F.col("a"))), FEATURES, "id", None)


def test_network_is_fitted_in_one_job_whatever_its_tasks(spark, rows, monkeypatch):
    est = models.clf_mlp(3, 40, layers=(6, 2))
    monkeypatch.setattr(type(est), "fit", lambda *a: pytest.fail("MLlib fits it, one job per pass"))
    sizes = []
    for per_task in (100_000, 400):
        monkeypatch.setattr(session, "ROWS_PER_TASK", per_task)
        sizes.append(gang.tasks(spark, 1200))
        model = models.fitted(est, rows, FEATURES, "id", None)
        assert metrics.roc_auc(models.with_scores(model, rows, ["label"])).first()["auc"] > 0.85
        assert model.stages[-1].weights.size == 3 * 6 + 6 + 6 * 2 + 2
    assert sizes == [1, 3]


def test_gradient_of_the_network_leads_to_a_minimum():
    target = np.array([3.0, -2.0, 0.5])
    ask = lambda x: (float(((x - target) ** 4).sum() + ((x - target) ** 2).sum()), 4 * (x - target) ** 3 + 2 * (x - target))
    assert passes.minimised(ask, np.array([10.0, 10.0, 10.0]), 60, 1e-9) == pytest.approx(target, abs=1e-4)


def test_restarts_of_a_clustering_are_one_job(spark, monkeypatch):
    df = spark.range(900).select((F.col("id") % 3 * 10 + uniform(F.col("id").cast("string"), "x")).alias("x"), (F.col("id") % 2 * 10 + uniform(F.col("id").cast("string"), "y")).alias("y"))
    monkeypatch.setattr(segments.KMeans, "fit", lambda *a: pytest.fail("MLlib fits it, one job per pass"))
    model, stats, cost = segments.fit_kmeans(df, ["x", "y"], k=6, restarts=10)
    monkeypatch.setattr(session, "ROWS_PER_TASK", 300)
    again = segments.fit_kmeans(df, ["x", "y"], k=6, restarts=10)
    assert cost == pytest.approx(again[2]) and cost < 900 * 0.02 and len(model.clusterCenters()) == 6
    sizes = segments.assign_segments(df, ["x", "y"], model, stats).groupBy("segment").count().collect()
    assert [r["count"] for r in sizes] == [150] * 6


def test_a_clustering_of_few_values_has_as_many_centres(spark):
    model, _, cost = segments.fit_kmeans(spark.range(50).select((F.col("id") % 2).cast("double").alias("x")), ["x"], k=4, restarts=2)
    assert len(model.clusterCenters()) == 2 and cost == 0


def test_thresholds_stand_for_equal_shares():
    values, counts = grow.compressed(np.arange(100_000.0), np.ones(100_000))
    assert len(values) == grow.SUMMARY and counts.sum() == 100_000
    cuts = grow.cuts_of(values, counts, 32)
    assert len(cuts) == 31 and np.abs(np.diff(cuts) - 3125).max() < 250
    assert grow.cuts_of(*grow.compressed(np.array([2.0, 1.0, 2.0]), np.ones(3)), 32).tolist() == [1.5]
    assert grow.cuts_of(*grow.compressed(np.array([1.0, 1.0]), np.ones(2)), 32).tolist() == []


@pytest.mark.parametrize(
    ("name", "sizes"),
    [("Boosted Trees", {"maxIter": 300, "maxDepth": 5}), ("Random Forest", {"numTrees": 200, "maxDepth": 10}), ("Neural Network", {"maxIter": 50}), ("Logistic Regression", {"maxIter": 1000})],
)
def test_hold_out_is_scored_by_whole_families(spark, monkeypatch, name, sizes):
    class Seen(Exception):
        pass

    def compared(rows, features, key, estimators, balance):
        raise Seen({n: estimators[name].getOrDefault(n) for n in sizes})

    monkeypatch.setattr(modelling, "_prepared", lambda *a: (SimpleNamespace(features=["x", "y"]), spark.range(10)))
    monkeypatch.setattr(models, "compare_families", compared)
    with pytest.raises(Seen) as seen:
        modelling._holdout(spark, "", name)
    assert seen.value.args[0] == sizes


def test_tuning_has_the_whole_grid(spark, monkeypatch):
    class Seen(Exception):
        pass

    def searched(base, grid, *a, **k):
        raise Seen(grid)

    monkeypatch.setattr(modelling, "planted", lambda *a: None)
    monkeypatch.setattr(models, "prepared", lambda *a: (SimpleNamespace(features=["x"]), spark.range(4).withColumn("is_test", F.col("id") > 2)))
    monkeypatch.setattr(models, "grid_search", searched)
    with pytest.raises(Seen) as seen:
        modelling.grid_search(spark, "")
    assert seen.value.args[0] == models.TUNING_GRID
