from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.operators import daily, history


def log(spark, days=6, rows=2400):
    i = F.col("id")
    return spark.range(rows).select(
        F.concat(F.lit("2024-01-0"), (1 + i % days).cast("string")).alias("date"), (i % 13).alias("user_id"),
        F.when(i % 3 == 0, "CHURN").otherwise("STAY").alias("prediction"), F.when(i % 7 == 0, "High Risk").otherwise("Low Risk").alias("risk_level"),
        F.when(i % 10 == 0, None).when(i % 10 == 1, float("nan")).otherwise(F.pow(i % 997, 2.0)).alias("x"), (F.col("id") * 3.0 + 1e9).alias("y"), F.lit(None).cast("double").alias("z"),
    )


def test_counts_of_days_add_up(spark, tmp_path):
    rows = log(spark)
    parts = daily.day_counts(rows)
    daily.store_days(parts, str(tmp_path / "parts"))
    got = daily.total_counts(daily.stored_days(spark, str(tmp_path / "parts"), parts.schema))
    want = history.history_summary(rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_new_day_reads_that_day_only(spark, tmp_path):
    source, path = str(tmp_path / "log"), str(tmp_path / "parts")
    rows = log(spark, days=4)
    rows.filter("date < '2024-01-04'").write.partitionBy("date").parquet(source)
    read = lambda: spark.read.schema(rows.schema).parquet(source)
    parts = daily.day_counts(rows)
    daily.store_days(daily.day_counts(read()), path)
    rows.filter("date = '2024-01-04'").write.mode("append").partitionBy("date").parquet(source)
    # whoever opens another day fails
    for f in Path(source).glob("date=2024-01-0[123]/*.parquet"):
        f.write_bytes(b"no parquet")
    fresh = daily.of_days(read(), ["2024-01-04"])
    assert "PartitionFilters: [date" in fresh._jdf.queryExecution().toString().replace("isnotnull(", "")
    daily.store_days(daily.day_counts(fresh), path)
    got = daily.total_counts(daily.stored_days(spark, path, parts.schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, history.history_summary(rows).collect()))


def test_a_day_stored_again_replaces_itself(spark, tmp_path):
    path, rows = str(tmp_path / "parts"), log(spark, days=3)
    parts = daily.day_counts(rows)
    daily.store_days(parts, path)
    daily.store_days(daily.day_counts(daily.of_days(rows, ["2024-01-02"])), path)
    assert daily.stored_days(spark, path, parts.schema).exceptAll(parts.select(*daily.stored_days(spark, path, parts.schema).columns)).isEmpty()


def test_merged_sketches(spark, tmp_path):
    rows = log(spark, rows=30_000)
    parts = daily.day_sketches(rows, ["x", "y", "z"])
    daily.store_days(parts, str(tmp_path / "sketches"))
    found = {r["column"]: r for r in daily.total_stats(daily.stored_days(spark, str(tmp_path / "sketches"), parts.schema)).collect()}
    data = rows.select("x", "y").toPandas()
    for c in ("x", "y"):
        v, r = np.sort(data[c].dropna().to_numpy()), found[c]
        assert (r["rows"], r["n"], r["nulls"]) == (30_000, len(v), 30_000 - len(v))
        assert (r["low"], r["high"]) == (v[0], v[-1])
        assert r["mean"] == pytest.approx(v.mean(), rel=1e-12) and r["std"] == pytest.approx(v.std(ddof=1), rel=1e-9)
        for q, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
            assert np.searchsorted(v, r[name], "left") / len(v) - 0.01 <= q <= np.searchsorted(v, r[name], "right") / len(v) + 0.01
    assert (found["z"]["n"], found["z"]["nulls"], found["z"]["mean"], found["z"]["q50"]) == (0, 30_000, None, None)
