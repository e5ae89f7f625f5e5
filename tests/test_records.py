import random

import pytest

from pyspark.sql import functions as F

from holdfast.operators import dashboard, history, revenue, segments


def tried_one_by_one(existing, batch):
    names, mails = {u for u, _ in existing}, {e for _, e in existing}
    ok = []
    for seq, u, e in sorted(batch):
        if u not in names and e not in mails:
            names.add(u)
            mails.add(e)
            ok.append(seq)
        # a null key is never taken
        names.discard(None)
        mails.discard(None)
    return ok


def test_insert_if_unique_equals_sequential_attempts(spark):
    rng = random.Random(11)
    existing = [("u0", "e0"), ("u1", "e9")]
    batch = [(i, f"u{rng.randrange(25)}" if i % 3 else "u7", f"e{rng.randrange(30)}") for i in range(120)]
    old = spark.createDataFrame(existing, "username string, email string")
    new = spark.createDataFrame(batch, "seq int, username string, email string").repartition(5)
    got = sorted(r["seq"] for r in history.insert_if_unique(old, new, "seq").collect())
    assert got == tried_one_by_one(existing, batch)


@pytest.mark.parametrize("in_order", [3, 40, 1000])
def test_insert_if_unique_in_components_of_any_size(spark, in_order):
    rng = random.Random(in_order)
    existing = [("u0", "e0")]
    pairs = [(f"u{rng.randrange(60)}" if i % 4 else None, f"e{rng.randrange(70)}" if i % 5 else None) for i in range(90)]
    pairs += [(f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(30)] + [("hot", f"h{i}") for i in range(30)] + [(f"s{i}", f"t{i}") for i in range(10)]
    rng.shuffle(pairs)
    batch = [(i, *p) for i, p in enumerate(pairs)]
    old = spark.createDataFrame(existing, "username string, email string")
    new = spark.createDataFrame(batch, "seq int, username string, email string").repartition(4)
    got = sorted(r["seq"] for r in history.insert_if_unique(old, new, "seq", in_order=in_order).collect())
    assert got == tried_one_by_one(existing, batch)


def test_chain_of_conflicts_takes_few_jobs(spark):
    batch = [(i, f"u{i // 2}", f"e{(i + 1) // 2}") for i in range(1000)]
    old = spark.createDataFrame([], "username string, email string")
    new = spark.createDataFrame(batch, "seq int, username string, email string")
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        got = sorted(r["seq"] for r in history.insert_if_unique(old, new, "seq").collect())
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == tried_one_by_one([], batch) and jobs < 20


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k * 37 % 101, (k + 1) * 37 % 101) for k in range(60)] + [(500, 501), (7, 7)], "a bigint, b bigint")
    labels = {r["node"]: r["label"] for r in history.connected(edges).collect()}
    path = {k * 37 % 101 for k in range(61)}
    assert len({labels[k] for k in path}) == 1 and labels[500] == labels[501] != labels[37]


def test_join_keeps_idle_users(spark):
    users = spark.createDataFrame([(1, "a"), (2, "b")], "id int, username string")
    log = spark.createDataFrame([(10, 1), (11, 1)], "id int, user_id int")
    rows = history.join_user_predictions(users, log).orderBy("user_id", "id").collect()
    assert [(r["user_id"], r["user_username"], r["id"]) for r in rows] == [(1, "a", 10), (1, "a", 11), (2, "b", None)]


def test_cascade_delete_and_login(spark):
    users = spark.createDataFrame([(1, None), (2, 5)], "id int, last_login int")
    log = spark.createDataFrame([(10, 1), (11, 2)], "id int, user_id int")
    gone = spark.createDataFrame([(1,), (1,), (9,)], "user_id int")
    u, p = history.cascade_delete(users, log, gone)
    assert [r["id"] for r in u.collect()] == [2] and [r["id"] for r in p.collect()] == [11]
    logins = spark.createDataFrame([(1, 3), (1, 7), (2, 4)], "user_id int, ts int")
    assert {r["id"]: r["last_login"] for r in history.touch_last_login(users, logins).collect()} == {1: 7, 2: 5}


def test_filters(spark):
    log = spark.createDataFrame([("CHURN", "High Risk"), ("STAY", "Low Risk"), ("CHURN", "Low Risk")], "prediction string, risk_level string")
    assert history.filter_history(log).count() == 3
    assert history.filter_history(log, "CHURN").count() == 2
    assert history.filter_history(log, "CHURN", "Low Risk").count() == 1
    probs = spark.createDataFrame([(0.75,), (0.7499,), (None,)], "p double")
    assert history.filter_alerts(probs, "p").count() == 1
    assert history.alert_digest(probs, "p", 0.75).first()["message"] == "1 customers at or above 75% churn probability"


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "Churn_Prediction string, Risk_Level string")
    row = dashboard.bulk_summary(empty).first()
    assert row["customers"] == 0 and row["churn_rate"] is None
    nobody = spark.createDataFrame([], "churn int")
    assert dashboard.platform_overview(nobody).first()["churn_rate"] == 0.0


def test_revenue_numbers(spark):
    rows = [("telecom", i < 33) for i in range(100)]
    df = spark.createDataFrame(rows, "industry string, c boolean")
    r = revenue.revenue_impact(df, "c", revenue.parameter_table(spark)).first()
    assert (r["ltv"], r["monthly_loss"], r["annual_loss"], r["lifetime_loss"]) == (1560.0, 2145.0, 25740.0, 51480.0)
    assert (r["customers_saved"], r["revenue_saved"], r["retention_spend"], r["net_benefit"]) == (9, 14040.0, 825.0, 13215.0)
    free = revenue.revenue_impact(df, "c", revenue.parameter_table(spark, {"telecom": {"cost": 0}})).first()
    assert free["roi_pct"] == 0.0
    months = revenue.projection_12m(revenue.revenue_impact(df, "c", revenue.parameter_table(spark))).collect()
    assert len(months) == 12 and months[-1]["cumulative_saved"] == 14040.0


def test_segment_names_and_share(spark):
    profile = spark.createDataFrame([(0, 0.1, 5), (1, 0.5, 5), (2, 0.5, 1)], "segment int, churn_rate double, customers int")
    ranked = {r["segment"]: r["rank"] for r in segments.rank_segments(profile).collect()}
    assert ranked == {1: 1, 2: 2, 0: 3}
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "segment int")
    assert {r["segment"]: float(r["share_pct"]) for r in segments.segment_share(df).collect()} == {0: 75.0, 1: 25.0}


def test_sample_per_group_limits_before_the_shuffle(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3 == 0).cast("int").alias("g"))
    out = segments.sample_per_group(df, "g", "id", 100)
    assert {r["g"]: r["count"] for r in out.groupBy("g").count().collect()} == {0: 100, 1: 100}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_kmeans_cost_falls_with_k(spark):
    df = spark.range(300).select((F.col("id") % 3 * 10 + F.col("id") % 7 * 0.1).alias("a"), (F.col("id") % 2 * 5.0).alias("b"))
    costs = [segments.fit_kmeans(df, ["a", "b"], k, restarts=2)[2] for k in (2, 4, 6)]
    assert costs[0] >= costs[1] >= costs[2]
