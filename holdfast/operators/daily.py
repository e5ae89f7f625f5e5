"""Aggregates kept per day of a growing table, so that a new day is read alone and totals come from small parts.

`day_counts` and `day_sketches` reduce a table to a few rows per day, `store_days` keeps them in a folder per day, replacing the
days that it is given and no others, and `total_counts` and `total_stats` merge the days again.  Counts, sums, means, variances
and extremes are exact; quantiles come from merged KLL sketches, whose rank error does not grow with the number of days:
about 1 % for K = 400.  The exact ways in `profile` and `history` stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import nan_to_null, ref
from .history import history_summary

K = 400
COUNTS = ("total", "churn", "stay", "high_risk")


def of_days(table: DataFrame, days: Sequence[str] | None, day: str = "date") -> DataFrame:
    """The rows of some days; where the table is stored by day, only their folders are read."""
    return table if days is None else table.filter(ref(day).isin(list(days)))


def day_counts(log: DataFrame, by: Sequence[str] = ("user_id",), day: str = "date") -> DataFrame:
    """The history summary of every day."""
    return history_summary(log, [day, *by])


def total_counts(parts: DataFrame, by: Sequence[str] = ("user_id",)) -> DataFrame:
    """The history summary of all days in `parts`."""
    return parts.groupBy(*[ref(b) for b in by]).agg(*[F.sum(c).alias(c) for c in COUNTS])


def day_sketches(df: DataFrame, columns: Sequence[str], day: str = "date", k: int = K) -> DataFrame:
    """(day, column, rows, n, mean, m2, low, high, sketch): rows, and the moments, extremes and quantile sketch of those with a
    value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), nan_to_null(ref(c).cast("double")).alias("value")) for c in columns])
    one = df.select(ref(day).alias(day), F.explode(pairs).alias("p")).select(day, "p.column", "p.value")
    value = F.col("value")
    facts = [
        F.count("*").alias("rows"), F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"),
        F.min(value).alias("low"), F.max(value).alias("high"), F.kll_sketch_agg_double(value, k).alias("sketch"),
    ]
    return one.groupBy(day, "column").agg(*facts)


def total_stats(parts: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, rows, n, nulls, mean, std, low, high, q25 ...) of all days in `parts`."""
    names = [f"q{round(100 * q):02d}" for q in quantiles]
    mean = F.sum(F.col("mean") * F.col("n")) / F.sum("n")
    sums = parts.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), mean.alias("all"), F.min("low").alias("low"), F.max("high").alias("high"))
    # spread inside the days and of the days around the mean of all
    apart = F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("all")) ** 2)
    spread = parts.join(sums.select("column", "all"), "column").groupBy("column").agg(apart.alias("m2"))
    merged = parts.filter("n > 0").groupBy("column").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    found = sums.join(spread, "column").join(merged, "column", "left")
    picked = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))).alias(name) for q, name in zip(quantiles, names)]
    std = F.sqrt(F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1)))
    return found.select("column", "rows", "n", (F.col("rows") - F.col("n")).alias("nulls"), F.col("all").alias("mean"), std.alias("std"), "low", "high", *picked)


def store_days(parts: DataFrame, path: str, day: str = "date") -> None:
    """Write parts into a folder per day; days that `parts` holds replace what is there, others stay."""
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def stored_days(spark: SparkSession, path: str, schema, day: str = "date") -> DataFrame:
    """The stored parts; `schema` is that of what was written."""
    return spark.read.schema(schema).parquet(path).withColumn(day, F.col(day))
