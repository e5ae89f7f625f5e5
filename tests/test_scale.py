"""Work that must not grow faster than the rows: joins by label, passes over the input, wide columns, restarts."""

import re

import pytest
from pyspark.sql import functions as F

from holdfast import session
from holdfast.operators import balance, encode, explain, metrics, models, order_stats, profile, segments, split


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def labelled(spark):
    """Rows too many, by Spark's estimate, for a plan that broadcasts what is counted from them."""
    return spark.range(2_000_000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("label"))


@pytest.mark.parametrize(
    "joined",
    [
        lambda df: balance.class_weight(df),
        lambda df: balance.oversample(df, "k"),
        lambda df: split.stratified_split(df, "k", "label"),
        lambda df: split.kfold_assign(df, "k", 3, label="label"),
    ],
    ids=["class_weight", "oversample", "stratified_split", "kfold_assign"],
)
def test_rows_are_not_dealt_by_label(labelled, joined):
    text = plan(joined(labelled))
    assert "BroadcastHashJoin" in text and not re.search(r"hashpartitioning\(__l", text)


def test_levels_count_values_once(spark, monkeypatch):
    calls, real = [], profile.value_counts
    monkeypatch.setattr(profile, "value_counts", lambda *a: calls.append(1) or real(*a))
    df = spark.createDataFrame([("b", "x"), ("a", None), ("b", "y")], "s string, t string")
    assert profile.levels(df, ["s", "t"]) == {"s": ["a", "b"], "t": ["x", "y"]} and len(calls) == 1


def test_preparation_computes_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def slow(x):
        seen.add(1)
        return f"l{x % 3}"

    df = spark.range(0, 50, 1, 2).select(slow("id").alias("t"), F.col("id").cast("double").alias("x"))
    prep = encode.fit_preparation(df)
    assert seen.value == 50 and prep.features == ["x", "t_l1", "t_l2"]


def test_wide_vectors_name_no_levels(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,), ("unseen",)], "s string")
    index = encode.level_index(df.filter("s <> 'unseen'"), ["s"])
    short, wide = (encode.sparse_onehot(df, index, {"s": 3}, named=n) for n in (3, 2))
    vectors = lambda out: {r["s"]: r["s_levels"] for r in out.collect()}
    assert vectors(short) == vectors(wide) and vectors(wide)["c"].size == 2
    assert wide.columns == short.columns and wide.schema["s_levels"].metadata == {"ml_attr": {"num_attrs": 2}}


def test_impacts_are_rounded_for_shown_rows_only(spark):
    up, down = [("Contract_A", 2.04), ("other", 1.0)], [("tenure", -3.06), ("Contract_B", -1.0)]
    rows = [(c, up, down) for c in (True, False, None)]
    df = spark.createDataFrame(rows, f"leaves boolean, risk_increasers {explain.PAIRS}, risk_decreasers {explain.PAIRS}")
    done = explain.recommend_from_attribution(df, ["Contract_A", "other", "tenure", "Contract_B"], F.col("leaves"))
    found = {r["leaves"]: [(a["action"], a["impact"]) for a in r["recommendations"]] for r in done.collect()}
    assert found[True] == [("CONTRACT_UPGRADE", 204.0), ("CONTACT_48H", None)]
    assert found[False] == found[None] == [("KEEP_SERVICE", None), ("LOYALTY_BENEFIT", 306.0)]
    ranked = explain.topk_attribution(df.select(F.col("risk_increasers").alias("attribution")))
    assert "sort_array(" in plan(ranked) and "array_sort(" not in plan(ranked)


def test_restarts_share_one_computed_input(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def slow(x):
        seen.add(1)
        return float(x % 10)

    df = spark.range(0, 200, 1, 2).select(slow("id").alias("x"))
    model, stats, cost = segments.fit_kmeans(df, ["x"], k=2, restarts=3, max_iter=5, parallelism=2)
    again = segments.fit_kmeans(df, ["x"], k=2, restarts=3, max_iter=5, parallelism=1)
    assert len(model.clusterCenters()) == 2 and stats["x"][0] == pytest.approx(4.5) and cost == pytest.approx(again[2])
    # dropping nulls computes a column for the filter and once more for the result
    assert seen.value <= 800


def test_smote_computes_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def slow(x):
        seen.add(1)
        return float(x % 17)

    df = spark.range(0, 120, 1, 2).select("id", slow("id").alias("x"), F.sqrt("id").alias("y"), (F.col("id") % 3 == 0).cast("double").alias("label"))
    made = balance.smote(df, ["x", "y"], "id", leaf_size=16)
    counts = {(r["label"], r["synthetic"]): r["count"] for r in made.groupBy("label", "synthetic").count().collect()}
    assert counts == {(0.0, False): 80, (1.0, False): 40, (1.0, True): 40} and seen.value == 120


def exchanged(df):
    """(what a shuffle deals by, its number of partitions) for the shuffles of the plan as it ran."""
    df.collect()
    return re.findall(r"(hashpartitioning|rangepartitioning)\([^\n]*?(\d+)\), REPARTITION_BY_NUM", plan(df))


def test_parts_of_a_sort_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 50)
    df = spark.range(1000).select(F.struct(F.lit(0).alias("g0")).alias("__key"), F.col("id").alias("__v"))
    found = order_stats.ranked(df)
    assert ("hashpartitioning", "20") in exchanged(found)
    assert [r["before"] for r in found.orderBy("__v").collect()] == list(range(1000))
    scored = spark.range(1000).select((F.col("id") >= 500).cast("int").alias("label"), F.col("id").cast("double").alias("score"))
    parts, n = order_stats.placed_by_ranges(scored, ["score"], "scores")
    assert n == 20 and parts.groupBy("__part").count().agg(F.max("count")).first()[0] < 200
    assert metrics.roc_auc(scored).first()["auc"] == 1.0


def test_fits_get_tasks_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 50)
    raw = spark.range(1000).select("id", (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, "Yes").otherwise("No").alias("Left"))
    prep, rows = models.prepared(raw, "Left", {"Yes": 1, "No": 0}, [], "id")
    assert rows.rdd.getNumPartitions() == 20 and rows.count() == 1000 and prep.features == ["x"]
    seen = []
    monkeypatch.setattr(models, "fitted", lambda est, train, *a: seen.append(train.rdd.getNumPartitions()) or (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        models.compare_families(rows.coalesce(1), prep.features, "id", {"any": None}, "weights")
    assert seen == [16]
