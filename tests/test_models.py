import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.functions.hashing import uniform
from holdfast.operators import balance, explain, metrics, models, neighbours
from holdfast.sources import retrain, store


@pytest.fixture(scope="module")
def rows(spark):
    """A planted label: churn when a + b is large, with a tenth of the rows flipped."""
    u = [uniform(F.col("id").cast("string"), s) for s in "abcn"]
    df = spark.range(1500).select(F.col("id").cast("string").alias("id"), *[x.alias(n) for x, n in zip(u[:3], "abc")], u[3].alias("noise"))
    y = ((F.col("a") + F.col("b") > 1.3) != (F.col("noise") < 0.05)).cast("double")
    return df.withColumn("label", y).drop("noise").persist()


FEATURES = ["a", "b", "c"]


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = np.unique(rng.normal(size=(700, 3)).round(1), axis=0)
    df = spark.createDataFrame([(r.tolist(), 1) for r in x], "vec array<double>, mult bigint").persist()
    got = {tuple(r["vec"]): [f["d"] for f in r["found"]] for r in neighbours.nearest(df, 4, leaf_size=60).collect()}
    assert len(got) == len(x)
    for r in x:
        d = np.sort(((x - r) ** 2).sum(axis=1))[1:5]
        assert got[tuple(r.tolist())] == pytest.approx(d, abs=1e-12)


def test_equal_rows_are_neighbours_of_each_other(spark):
    df = spark.createDataFrame([([0.0], 1000), ([1.0], 2), ([5.0], 1)], "vec array<double>, mult bigint")
    near = {tuple(r["vec"]): r["near"] for r in neighbours.neighbour_vectors(df, 3).collect()}
    assert near[(0.0,)] == [[0.0]] * 3
    assert near[(1.0,)] == [[1.0], [0.0], [0.0]]
    assert near[(5.0,)] == [[1.0], [1.0], [0.0]]


def test_smote_balances_and_interpolates(spark, rows):
    out = balance.smote(rows, FEATURES, "id", k=5, leaf_size=100).persist()
    counts = {(r["label"], r["synthetic"]): r["count"] for r in out.groupBy("label", "synthetic").count().collect()}
    assert counts[(1.0, False)] + counts[(1.0, True)] == counts[(0.0, False)]
    real = np.array([[r[f] for f in FEATURES] for r in rows.filter("label = 1").collect()])
    made = np.array([[r[f] for f in FEATURES] for r in out.filter("synthetic").collect()])
    order = np.argsort(((real[:, None] - real[None]) ** 2).sum(axis=2), axis=1)[:, 1:6]
    starts = np.repeat(real, 5, axis=0)
    steps = real[order.ravel()] - starts
    for s in made[:60]:
        gap = ((s - starts) * steps).sum(axis=1) / (steps**2).sum(axis=1)
        off = np.abs(starts + gap[:, None] * steps - s).max(axis=1)
        assert ((off < 1e-9) & (gap >= -1e-9) & (gap <= 1 + 1e-9)).any()
    again = balance.smote(rows.repartition(6), FEATURES, "id", k=5, leaf_size=100)
    assert out.exceptAll(again).isEmpty()


def test_smote_with_one_value_held_by_most_rows(spark):
    df = spark.range(400).select("id", F.when(F.col("id") % 4 == 0, 1.0).otherwise(0.0).alias("label"), F.when(F.col("id") % 3 == 0, F.col("id") * 1.0).otherwise(7.0).alias("x"))
    out = balance.smote(df, ["x"], "id")
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {0.0: 300, 1.0: 300}


def test_class_weights_give_equal_mass(spark, rows):
    mass = {r["label"]: r["w"] for r in balance.class_weight(rows).groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    assert mass[0.0] == pytest.approx(mass[1.0]) == pytest.approx(750)


def test_families_find_the_planted_signal(spark, rows):
    split = rows.withColumn("is_test", uniform(F.col("id"), "t") < 0.25)
    scored = models.compare_families(split, FEATURES, "id", models.families(3, 400, small=True), balance="weights")
    table = {r["model"]: r["auc"] for r in metrics.compare_models(scored).collect()}
    assert len(table) == 4 and all(auc > 80 for auc in table.values()), table


def test_cross_validation_and_grid(spark, rows):
    folds = models.cross_val(models.clf_logreg(30), rows, FEATURES, "id", 3, balance="smote")
    assert folds.count() == 3 and all(r["auc"] > 0.8 for r in folds.collect())
    table, best = models.grid_search(models.clf_boost(3, 2, 0.1), {"maxDepth": [1, 3]}, rows, FEATURES, "id", 2)
    assert table.count() == 2 and best["maxDepth"] in (1, 3)


@pytest.fixture(scope="module")
def boosted(rows):
    return models.assembled(FEATURES, models.clf_boost(5, 3, 0.3, min_rows=1)).fit(rows)


def test_tree_attribution_adds_up_to_the_margin(spark, rows, boosted):
    trees = explain.tree_arrays(boosted)
    out = explain.attribution_tree(rows, boosted, FEATURES, ["id"], trees).collect()
    probability = {r["id"]: r["score"] for r in models.with_scores(boosted, rows, ["id"]).collect()}
    start = explain.baseline(trees)
    for r in out:
        margin = start + sum(p["value"] for p in r["attribution"])
        assert 1 / (1 + np.exp(-margin)) == pytest.approx(probability[r["id"]], abs=1e-6)


def test_tree_attribution_equals_subset_enumeration(spark, rows, boosted):
    from itertools import combinations
    from math import factorial

    trees = explain.tree_arrays(boosted)

    def expectation(t, node, x, known):
        if t["left"][node] < 0:
            return t["value"][node]
        f = t["feature"][node]
        a, b = t["left"][node], t["right"][node]
        if f in known:
            return expectation(t, a if x[f] <= t["cut"][node] else b, x, known)
        wa, wb = t["cover"][a] / t["cover"][node], t["cover"][b] / t["cover"][node]
        return wa * expectation(t, a, x, known) + wb * expectation(t, b, x, known)

    sample = rows.orderBy("id").limit(6)
    for r in explain.attribution_tree(sample, boosted, FEATURES, FEATURES, trees).collect():
        x = [r[f] for f in FEATURES]
        for j in range(3):
            others = [i for i in range(3) if i != j]
            want = 0.0
            for size in range(3):
                for known in combinations(others, size):
                    w = factorial(size) * factorial(2 - size) / factorial(3)
                    want += w * sum(t["weight"] * (expectation(t, 0, x, {*known, j}) - expectation(t, 0, x, set(known))) for t in trees)
            assert r["attribution"][j]["value"] == pytest.approx(want, abs=1e-9)


def test_tree_attribution_with_tiny_shares(spark):
    """Eight features on one path, shares down to 1e-5, passing and failing features mixed."""
    from itertools import combinations
    from math import factorial

    shares = [1e-5, 0.7, 0.6, 1e-4, 0.3, 0.9, 0.5, 0.4]
    m, cover = len(shares), [1e9]
    tree = {"weight": 1.0, "left": [], "right": [], "feature": [], "cut": [], "value": [], "cover": []}
    for f, z in enumerate(shares):
        here = cover[-1]
        for name, x in (("left", 2 * f + 2), ("right", 2 * f + 1), ("feature", f), ("cut", 0.5), ("value", 0.0), ("cover", here)):
            tree[name].append(x)
        for name, x in (("left", -1), ("right", -1), ("feature", -1), ("cut", 0.0), ("value", 0.25 * f), ("cover", here * (1 - z))):
            tree[name].append(x)
        cover.append(here * z)
    for name, x in (("left", -1), ("right", -1), ("feature", -1), ("cut", 0.0), ("value", 1.0), ("cover", cover[-1])):
        tree[name].append(x)

    def expectation(x, known):
        total, reach = 0.0, 1.0
        for f, z in enumerate(shares):
            go = (1.0 if x[f] <= 0.5 else 0.0) if f in known else z
            total, reach = total + reach * (1 - go) * 0.25 * f, reach * go
        return total + reach

    names = [f"f{i}" for i in range(m)]
    points = [[0.0] * m, [1.0] * m, [0, 1, 0, 0, 0, 1, 0, 0], [0, 0, 0, 0, 0, 0, 0, 1]]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id int, " + ", ".join(f"{n} double" for n in names))
    for r in explain.attribution_tree(df, None, names, ["id"], [tree]).collect():
        x = points[r["id"]]
        for j in range(m):
            want, others = 0.0, [i for i in range(m) if i != j]
            for size in range(m):
                w = factorial(size) * factorial(m - size - 1) / factorial(m)
                want += sum(w * (expectation(x, {*k, j}) - expectation(x, set(k))) for k in combinations(others, size))
            assert r["attribution"][j]["value"] == pytest.approx(want, abs=1e-9)


def test_topk_and_recommendations(spark):
    names = ["Contract_Two year", "Contract_One year", "tenure", "Age", "Other", "Hour"]
    row = [(1, 1, [(n, v) for n, v in zip(names, [0.3, 0.2, -0.5, 0.1, 0.25, 0.0])]), (2, 0, [(n, v) for n, v in zip(names, [0.1, -0.2, -0.5, 0.1, -0.9, 0.0])])]
    df = spark.createDataFrame(row, f"id int, pred int, attribution {explain.PAIRS}")
    top = explain.topk_attribution(df, 3)
    first = top.filter("id = 1").first()
    assert [p["feature"] for p in first["top_features"]] == ["tenure", "Contract_Two year", "Other"]
    assert [p["feature"] for p in first["risk_decreasers"]] == ["tenure"]
    recs = {r["id"]: [(x["action"], x["impact"]) for x in r["recommendations"]] for r in explain.recommend_from_attribution(top, names, F.col("pred")).collect()}
    assert recs[1] == [("CONTRACT_UPGRADE", 30.0), ("CONTRACT_UPGRADE", 20.0), ("RELATIONSHIP_MANAGER", 10.0), ("CONTACT_48H", None)]
    assert recs[2] == [("KEEP_SERVICE", None), ("LOYALTY_BENEFIT", 50.0)]


def test_pattern_precedence():
    assert explain.churn_action("PaymentMethod_Electronic check") == "AUTO_PAYMENT"
    assert explain.churn_action("TENURE") == "ONBOARDING" and explain.churn_action("contract") is None
    assert explain.churn_action("NumOfProducts") == "PRODUCT_REVIEW" and explain.churn_action("HourSpendOnApp") == "PUSH_OFFER"
    assert explain.stay_action("IsActiveMember") == "VIP_PROGRAMME" and explain.stay_action("Fiber") is None


def test_training_saving_scoring(spark, rows, tmp_path):
    raw = rows.withColumn("left", F.when(F.col("label") == 1, "Yes").otherwise("No")).drop("label")
    done, failed = models.train_industries(
        {
            "ok": {"raw": raw, "target": "left", "target_map": {"Yes": 1, "No": 0}, "drop": [], "key": "id", "estimator": models.clf_logreg(30)},
            "bad": {"raw": raw.drop("left"), "target": "left", "target_map": None, "drop": [], "key": "id"},
        }
    )
    assert list(done) == ["ok"] and list(failed) == ["bad"]
    t = done["ok"]
    assert t.metrics().first()["auc"] > 80
    store.save_model(spark, str(tmp_path), "ok", "Ok", t.model, t.prep, t.params)
    model, prep, _ = store.load_model(spark, str(tmp_path), "ok")
    a = models.score_table(t.model, t.prep, raw, ["id"]).orderBy("id").collect()
    b = models.score_table(model, prep, raw, ["id"]).orderBy("id").collect()
    assert a == b and a[0]["prediction"] in ("WILL CHURN", "WILL STAY")
    status = {r["industry"]: r["status"] for r in store.model_registry(spark, str(tmp_path), ["ok", "none"]).collect()}
    assert status == {"ok": "ready", "none": "not trained"}
    with pytest.raises(FileNotFoundError):
        store.load_model(spark, str(tmp_path), "none")


def test_interrupted_save_leaves_the_model_before_ready(spark, rows, tmp_path, monkeypatch):
    raw = rows.withColumn("left", F.when(F.col("label") == 1, "Yes").otherwise("No")).drop("label")
    t = models.train_industry(raw, "ok", "left", {"Yes": 1, "No": 0}, [], "id", models.clf_logreg(5), balance="none")
    root = str(tmp_path)
    assert store.save_model(spark, root, "ok", "First", t.model, t.prep, {"n": 1}) == 1
    with monkeypatch.context() as m:
        m.setattr(store.versions, "publish", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError, match="stopped"):
            store.save_model(spark, root, "ok", "Second", t.model, t.prep, {"n": 2})
    assert store.load_model(spark, root, "ok")[2] == {"n": 1}
    assert store.save_model(spark, root, "ok", "Third", t.model, t.prep, {"n": 3}) == 2
    line = store.model_registry(spark, root, ["ok"]).first()
    assert (line["name"], line["status"], line["version"]) == ("Third", "ready", 2)
    assert store.load_model(spark, root, "ok", version=1)[2] == {"n": 1}


def test_first_rounds_of_a_longer_fit_are_the_shorter_fit(spark, rows):
    long = models.fitted(models.clf_boost(9, 3, 0.2), rows, FEATURES, "id", None)
    scored = models.prefix_scores(long, rows, FEATURES, ["id"], [4, 9]).toPandas().set_index("id").sort_index()
    for m in (4, 9):
        short = models.fitted(models.clf_boost(m, 3, 0.2), rows, FEATURES, "id", None)
        want = models.with_scores(short, rows, ["id"]).toPandas().set_index("id").sort_index()
        assert scored[f"score_{m}"].to_numpy() == pytest.approx(want["score"].to_numpy(), abs=1e-9)
    with pytest.raises(ValueError, match="9 rounds"):
        models.prefix_scores(long, rows, FEATURES, ["id"], [10])


def test_grid_fits_the_longest_of_each_combination_only(spark, rows, monkeypatch):
    made = []
    real = models.fitted
    monkeypatch.setattr(models, "fitted", lambda est, *a: made.append(est.getMaxIter()) or real(est, *a))
    grid = {"maxIter": [2, 5], "maxDepth": [2, 3]}
    table, _ = models.grid_search(models.clf_boost(seed=7), grid, rows, FEATURES, "id", 2)
    assert sorted(made) == [5] * 4 and table.count() == 4
    alone, _ = models.grid_search(models.clf_boost(seed=7), {"maxIter": [2], "maxDepth": [2, 3]}, rows, FEATURES, "id", 2)
    got = {r["parameters"]: r["mean_auc"] for r in table.collect()}
    assert all(got[r["parameters"]] == pytest.approx(r["mean_auc"], abs=1e-9) for r in alone.collect())


def test_penalties_count_the_rows_of_the_fit(spark, rows):
    n = rows.count()
    boost = models.fitted(models.clf_boost(1, 2), rows, FEATURES, "id", None).stages[-1]
    assert boost.getMinInfoGain() == pytest.approx(0.1 / n)
    assert models.fitted(models.clf_logreg(5, c=0.5), rows, FEATURES, "id", None).stages[-1].getRegParam() == pytest.approx(2.0 / n)
    assert models.clf_boost(rows=50).getMinInfoGain() == pytest.approx(0.1 / 50)


def test_near_neighbours_in_many_dimensions(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(2500, 20)), (rng.random((500, 20)) < 0.4).astype(float)])
    x = np.unique(x, axis=0)
    df = spark.createDataFrame([(r.tolist(), 1) for r in x], "vec array<double>, mult bigint")
    got = {tuple(r["vec"]): [f["d"] for f in r["found"]] for r in neighbours.nearest(df, 5, leaf_size=400).collect()}
    hits = 0
    for i in range(0, len(x), 20):
        want = np.sort(((x - x[i]) ** 2).sum(axis=1))[1:6]
        found = got[tuple(x[i].tolist())]
        assert len(found) == 5 and found == sorted(found)
        hits += int((np.array(found) <= want[-1] + 1e-9).sum())
    assert hits >= 0.9 * 5 * len(range(0, len(x), 20))


def test_neighbours_of_few_points(spark):
    assert neighbours.nearest(spark.createDataFrame([], "vec array<double>, mult bigint"), 3).collect() == []
    one = spark.createDataFrame([([1.0, 2.0], 3)], "vec array<double>, mult bigint")
    assert [r["near"] for r in neighbours.neighbour_vectors(one, 3).collect()] == [[[1.0, 2.0]] * 2]


def test_retraining_stores_a_new_version(spark, rows, tmp_path):
    raw = rows.withColumn("left", F.when(F.col("label") == 1, "Yes").otherwise("No")).drop("label")
    root = str(tmp_path)
    first = retrain.retrain(spark, root, raw, "ok", "Ok", "left", {"Yes": 1, "No": 0}, [], "id", models.clf_logreg(20), grid=None, balance="weights", folds=0)
    assert first.version == 1 and first.folds is None
    grid = {"maxIter": [2, 4], "maxDepth": [2]}
    again = retrain.retrain(spark, root, raw, "ok", "Ok", "left", {"Yes": 1, "No": 0}, [], "id", models.clf_boost(), grid=grid, balance="smote", folds=2)
    assert again.version == 2 and again.folds.count() == 2 and again.trained.params["maxDepth"] == 2
    assert again.report.count() > 1
    _, _, params = store.load_model(spark, root, "ok")
    assert params == again.trained.params and store.load_model(spark, root, "ok", version=1)[2] == {}
    with pytest.raises(Exception, match="absent"):
        retrain.retrain(spark, root, raw, "ok", "Ok", "left", {"Yes": 1, "No": 0}, [], "absent", models.clf_logreg(5), grid=None)
    assert store.model_registry(spark, root, ["ok"]).first()["version"] == 2
