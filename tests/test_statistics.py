import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.operators import metrics, order_stats, profile, split


@pytest.mark.parametrize("shape", ["uniform", "hot", "steps", "wide"])
def test_quantiles_by_narrowing_match_numpy(spark, shape):
    rng = random.Random(3)
    n = 6000
    make = {
        "uniform": lambda i: rng.random() * 100,
        "hot": lambda i: 5.0 if i % 3 else rng.random() * 10,
        "steps": lambda i: float(rng.randrange(4)),
        "wide": lambda i: 10 ** rng.uniform(-200, 200),
    }[shape]
    data = [(make(i), i % 2) for i in range(n)]
    df = spark.createDataFrame(data, "v double, g int").repartition(4)
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
    got = order_stats.quantiles(df, ["v"], probs, by=["g"])
    for g in (0, 1):
        values = [v for v, h in data if h == g]
        assert got[(g,)]["v"] == pytest.approx(np.quantile(values, probs), rel=1e-12)


def test_quantiles_of_missing_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None)], "a double, b double")
    assert order_stats.medians(df, ["a", "b"]) == {"a": 2.0, "b": None}
    df = df.withColumn("g", F.when(F.col("a") == 1.0, "x"))
    assert order_stats.quantiles(df, ["a", "b"], (0.5,), by=["g"]) == {("x",): {"a": [1.0], "b": [None]}, (None,): {"a": [3.0], "b": [None]}}


def test_select_ranks_on_longs_beyond_double_precision(spark):
    df = spark.range(3000).select((F.lit(2**60) + F.col("id")).alias("h"))
    got = order_stats.select_ranks(df, "h", [0, 1499, 2999, 3000])
    assert got == {0: 2**60, 1499: 2**60 + 1499, 2999: 2**60 + 2999}


def test_box_stats_and_describe(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(v, "x") for v in values], "v double, g string")
    box = profile.box_stats(df, "v", "g").first()
    assert (box["q1"], box["median"], box["q3"], box["whisker_low"], box["whisker_high"], box["outliers"]) == (2.0, 3.0, 4.0, 1.0, 4.0, 1)
    d = profile.describe(df, ["v"]).first()
    assert d["count"] == 5 and d["mean"] == 22.0 and d["std"] == pytest.approx(statistics.stdev(values)) and d["q50"] == 3.0


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(1)
    data = [(float(v), "a") for v in rng.normal(size=500)] + [(2.0, "b")] * 7
    df = spark.createDataFrame(data, "v double, g string")
    rows = profile.histogram_by_class(df, "v", "g").collect()
    for g in "ab":
        mine = [r["n"] for r in sorted((r for r in rows if r["cls"] == g), key=lambda r: r["bin"])]
        assert mine == np.histogram([v for v, h in data if h == g], bins=20)[0].tolist()


def test_exact_split_sizes_and_folds(spark):
    df = spark.range(1003).select("id", F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("y"))
    cut = split.stratified_split(df, "id", "y", 0.2, exact=True)
    sizes = {(r["y"], r["is_test"]): r["n"] for r in split.split_counts(cut, "y").collect()}
    assert sizes == {(0, True): 180, (0, False): 722, (1, True): 20, (1, False): 81}
    folds = split.kfold_assign(df, "id", 5, label="y", exact=True)
    per = {(r["y"], r["fold"]): r["count"] for r in folds.groupBy("y", "fold").count().collect()}
    assert {per[(0, i)] for i in range(5)} <= {180, 181} and {per[(1, i)] for i in range(5)} <= {20, 21}


def test_split_does_not_depend_on_partitioning(spark):
    df = spark.range(500).select("id", F.lit(1).alias("y"))
    a = split.stratified_split(df, "id", "y").filter("is_test").select("id")
    b = split.stratified_split(df.repartition(7), "id", "y").filter("is_test").select("id")
    assert a.exceptAll(b).isEmpty() and a.count() == b.count()


def auc_by_pairs(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("parts", ["1", "7"])
def test_auc_with_ties_equals_all_pairs(spark, parts):
    rng = random.Random(5)
    rows = [(rng.randrange(40) / 40, int(rng.random() < 0.4)) for _ in range(400)]
    df = spark.createDataFrame(rows, "score double, label int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = metrics.roc_auc(df).first()["auc"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == pytest.approx(auc_by_pairs(rows), abs=1e-12)


def test_auc_edge_cases(spark):
    one = spark.createDataFrame([(0.5, 1), (0.7, 1)], "score double, label int")
    assert metrics.roc_auc(one).first()["auc"] is None
    tied = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 0)], "score double, label int")
    assert metrics.roc_auc(tied).first()["auc"] == 0.5


def test_metrics_without_positive_predictions(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "label int, pred int")
    m = metrics.binary_metrics(df).first()
    assert (m["accuracy"], m["precision"], m["recall"], m["f1"]) == (50.0, 0.0, 0.0, 0.0)
    report = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert report["Churn"]["precision"] == 0.0 and report["accuracy"]["f1"] == 0.5 and report["macro avg"]["support"] == 2


def test_argmax_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("b", 0.9), ("a", 0.9), ("c", 0.1)], "model string, auc double")
    assert metrics.argmax_model(df).first()["model"] == "a"
    flags = {r["model"]: r["auc_is_max"] for r in metrics.highlight_max(df, ["auc"]).collect()}
    assert flags == {"a": True, "b": True, "c": False}
