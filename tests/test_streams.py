from pyspark.sql import functions as F

from holdfast.functions.rules import score_by_rules
from holdfast.sources import views
from holdfast.streaming import flows


def test_scored_stream_equals_batch(spark, base, tmp_path):
    rows = views.accounts(spark, base).select("customerID", "tenure", "Contract", "MonthlyCharges", "InternetService")
    landing = str(tmp_path / "in")
    rows.repartition(3).write.parquet(landing)
    out = str(tmp_path / "out")
    stream = flows.score_stream(flows.stream_files(spark, landing, rows.schema, max_files=1))
    flows.to_files(stream, out, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(out)
    want = score_by_rules(rows).select(got.columns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_alert_stream_equals_batch_and_resumes(spark, base, tmp_path):
    events = views.table(spark, base, "events")
    landing, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    days = events.withColumn("half", F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    for half in (True, False):
        days.filter(F.col("half") == half).drop("half").coalesce(1).write.mode("append").parquet(landing)
        log = views.predictions_of(flows.stream_files(spark, landing, events.schema))
        flows.upsert_counts(flows.alert_counts(log, 0.5), out, cp).awaitTermination()
    got = flows.latest_counts(spark, out)
    want = flows.alert_counts_batch(views.predictions_of(events), 0.5).select(got.columns)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    landing, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "created_at timestamp, user_id int, churn_probability double"

    def arrive(*stamps):
        spark.createDataFrame([(s, 1, 0.9) for s in stamps], "s string, user_id int, churn_probability double").select(
            F.col("s").cast("timestamp").alias("created_at"), "user_id", "churn_probability"
        ).coalesce(1).write.mode("append").parquet(landing)
        flows.upsert_counts(flows.alert_counts(flows.stream_files(spark, landing, schema)), out, cp).awaitTermination()

    arrive("2024-01-01 10:00:00")
    arrive("2024-01-05 10:00:00")
    arrive("2024-01-01 11:00:00", "2024-01-05 11:00:00")
    counts = {str(r["day"])[:10]: r["alerts"] for r in flows.latest_counts(spark, out).collect()}
    assert counts == {"2024-01-01": 1, "2024-01-05": 2}


def test_a_replayed_file_changes_no_count(spark, tmp_path):
    landing, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "id int, created_at timestamp, user_id int, churn_probability double"

    def arrive(*entries):
        rows = spark.createDataFrame([(i, s, 1, 0.9) for i, s in entries], "id int, s string, user_id int, churn_probability double")
        rows.select("id", F.col("s").cast("timestamp").alias("created_at"), "user_id", "churn_probability").coalesce(1).write.mode("append").parquet(landing)
        flows.upsert_counts(flows.alert_counts(flows.stream_files(spark, landing, schema)), out, cp).awaitTermination()
        return {str(r["day"])[:10]: r["alerts"] for r in flows.latest_counts(spark, out).collect()}

    first = [(1, "2024-01-01 10:00:00"), (2, "2024-01-01 10:10:00"), (2, "2024-01-01 10:10:00")]
    assert arrive(*first) == {"2024-01-01": 2}
    assert arrive(*first) == {"2024-01-01": 2}
    assert arrive((3, "2024-01-01 15:00:00")) == {"2024-01-01": 3}
    # behind the watermark by now, but of a day that is open still
    assert arrive(*first) == {"2024-01-01": 3}
    assert arrive((4, "2024-01-03 08:00:00"), *first) == {"2024-01-01": 3, "2024-01-03": 1}
