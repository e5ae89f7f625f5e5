"""Descriptive statistics that feed the fitted transforms and the data profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import nan_to_null, ref
from ..session import materialised
from .clean import numeric_columns
from .order_stats import quantile_table, quantiles


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) of all text columns in one pass; a frequent value is combined before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), ref(c).alias("value")) for c in columns])
    return (
        df.select(F.explode(pairs).alias("p"))
        .select("p.column", "p.value")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )


def modes(df: DataFrame, columns: Sequence[str], fallback: str = "Unknown") -> dict[str, str]:
    """Most frequent value, the smallest on ties; `fallback` for a column without values."""
    return {c: m for c, (m, _) in modes_and_cardinality(df, columns, fallback).items()}


def modes_and_cardinality(df: DataFrame, columns: Sequence[str], fallback: str = "Unknown", counts: DataFrame | None = None) -> dict[str, tuple[str, int]]:
    """(mode, number of levels) of each column; `counts` are its value counts, if the caller has them."""
    if not columns:
        return {}
    best = (value_counts(df, columns) if counts is None else counts).groupBy("column").agg(
        F.min(F.struct((-F.col("n")).alias("rank"), F.col("value").alias("value"))).alias("top"), F.count("*").alias("levels")
    )
    found = {r["column"]: (r["top"]["value"], r["levels"]) for r in best.collect()}
    return {c: found.get(c, (fallback, 0)) for c in columns}


def levels(
    df: DataFrame, columns: Sequence[str], max_levels: int = 1000, known: dict[str, int] | None = None, counts: DataFrame | None = None
) -> dict[str, list[str]]:
    """Sorted distinct values per text column.

    Columns with more than `max_levels` values are refused: they would become as many feature columns.  The values are counted
    once, into a table that both the sizes and the levels are read from.
    """
    if not columns:
        return {}
    counts = materialised(value_counts(df, columns), "levels") if counts is None else counts
    sizes = known if known is not None else {c: k for c, (_, k) in modes_and_cardinality(df, columns, counts=counts).items()}
    wide = {c: k for c, k in sizes.items() if k > max_levels}
    if wide:
        raise ValueError(f"too many levels for one column per level (limit {max_levels}): {wide}; drop or group these columns")
    rows = counts.filter(F.col("column").isin(list(columns))).select("column", "value").collect()
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in rows:
        out[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in out.items()}


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, population standard deviation) of every column in one aggregate."""
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        v = nan_to_null(ref(c).cast("double"))
        aggs += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0) for i, c in enumerate(columns)}


DESCRIBE_SCHEMA = "column string, count bigint, mean double, std double, min double, q25 double, q50 double, q75 double, max double"


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column: count, mean, sample deviation, extremes and exact quartiles."""
    spark: SparkSession = df.sparkSession
    columns = numeric_columns(df) if columns is None else list(columns)
    aggs = []
    for i, c in enumerate(columns):
        v = nan_to_null(ref(c).cast("double"))
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.avg(v).alias(f"m{i}"),
            F.stddev_samp(v).alias(f"s{i}"),
            F.min(v).alias(f"a{i}"),
            F.max(v).alias(f"z{i}"),
        ]
    row = df.agg(*aggs).first()
    found = quantiles(df, columns, (0.25, 0.5, 0.75))
    q = found.get((), {c: [None] * 3 for c in columns})
    data = [(c, row[f"n{i}"], row[f"m{i}"], row[f"s{i}"], row[f"a{i}"], *q[c], row[f"z{i}"]) for i, c in enumerate(columns)]
    return spark.createDataFrame(data, DESCRIBE_SCHEMA)


def profile_nulls(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null, missing) per column: one aggregate, then unpivoted to long form."""

    def present(f: T.StructField):
        c = ref(f.name)
        return nan_to_null(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c

    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(present(f)).alias(f"c{i}") for i, f in enumerate(df.schema)])
    entries = F.array(
        *[
            F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"c{i}").alias("non_null"))
            for i, f in enumerate(df.schema)
        ]
    )
    return one.select(F.explode(entries).alias("e"), "__n").select(
        "e.column", "e.dtype", "e.non_null", (F.col("__n") - F.col("e.non_null")).alias("missing")
    )


def dtype_counts(df: DataFrame) -> dict[str, int]:
    out: dict[str, int] = {}
    for f in df.schema:
        out[f.dataType.simpleString()] = out.get(f.dataType.simpleString(), 0) + 1
    return out


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(ref(label)).agg(F.count("*").alias("n"))


def count_by_hue(df: DataFrame, category: str, hue: str, hues: Sequence[str]) -> DataFrame:
    return df.groupBy(ref(category)).pivot(hue, list(hues)).agg(F.count(F.lit(1))).na.fill(0)


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles, whiskers (extreme values within 1.5 interquartile ranges) and outliers of each group.

    Quartiles are joined back by group, so groups may be many and one may hold most rows.
    """
    rows = df.select(ref(by).alias("g"), nan_to_null(ref(value).cast("double")).alias("v"))
    q = quantile_table(rows, ["v"], (0.25, 0.5, 0.75), ["g"]).select(F.struct(F.col("g").alias("g")).alias("__g"), "q")
    met = rows.withColumn("__g", F.struct(F.col("g").alias("g"))).join(q, "__g", "left")
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = (F.col("v") >= F.col("q")[0] - reach) & (F.col("v") <= F.col("q")[2] + reach)
    return (
        met.groupBy("g")
        .agg(
            F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
            F.count_if(F.col("v").isNotNull() & ~inside).alias("outliers"),
            *[F.max(F.col("q")[i]).alias(n) for i, n in enumerate(("q1", "median", "q3"))],
        )
        .withColumnRenamed("g", by)
    )


def histogram_by_class(df: DataFrame, value: str, by: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over each class's own range; the last bin is closed; empty bins count 0."""
    v = nan_to_null(ref(value).cast("double"))
    data = df.select(ref(by).alias("cls"), v.alias("v")).filter(F.col("v").isNotNull() & F.col("cls").isNotNull())
    lo, hi = F.col("lo"), F.col("hi")
    ranges = data.groupBy("cls").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranges = ranges.select("cls", F.when(lo < hi, lo).otherwise(lo - 0.5).alias("lo"), F.when(lo < hi, hi).otherwise(hi + 0.5).alias("hi"))
    width = (hi - lo) / F.lit(float(bins))
    binned = data.join(ranges, "cls").select("cls", F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = binned.groupBy("cls", "bin").agg(F.count("*").alias("n"))
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    grid = grid.select("cls", "bin", (lo + width * F.col("bin")).alias("left"), (lo + width * (F.col("bin") + 1)).alias("right"))
    return grid.join(counts, ["cls", "bin"], "left").na.fill({"n": 0})
