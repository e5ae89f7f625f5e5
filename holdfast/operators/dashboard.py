"""Churn rates and headline numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ref


def with_churn(df: DataFrame, target: str, mapping: Mapping[str, int] | None = None, name: str = "churn") -> DataFrame:
    """Adds the 0/1 churn column whatever the industry calls it."""
    from .clean import mapped

    return df.withColumn(name, mapped(ref(target), mapping) if mapping else ref(target).cast("int"))


def churn_rate_by_dim(df: DataFrame, dimension: str, churn: str = "churn") -> DataFrame:
    return (
        df.filter(ref(dimension).isNotNull())
        .groupBy(ref(dimension))
        .agg(F.bround(F.avg(ref(churn)) * 100.0, 1).alias("churn_rate"), F.count("*").alias("customers"))
    )


def churn_rate_multi_dim(df: DataFrame, dimensions: Sequence[str], churn: str = "churn") -> DataFrame:
    """All dimensions in one pass over the table: (dimension, value, churn_rate, customers)."""
    columns = [ref(d).cast("string").alias(d) for d in dimensions]
    table = df.select(*columns, ref(churn).alias("__churn"))
    names = F.array(*[F.lit(d) for d in dimensions])
    values = F.array(*[ref(d) for d in dimensions])
    # grouping_id has one bit per dimension, 0 for the dimension a row is grouped by.
    which = F.array_position(F.array(*[F.grouping(d) for d in dimensions]), F.lit(0).cast("tinyint")).cast("int")
    grouped = (
        table.groupingSets([[ref(d)] for d in dimensions], *[ref(d) for d in dimensions])
        .agg(which.alias("__i"), F.bround(F.avg("__churn") * 100.0, 1).alias("churn_rate"), F.count("*").alias("customers"))
    )
    return grouped.select(
        F.element_at(names, F.col("__i")).alias("dimension"), F.element_at(values, F.col("__i")).alias("value"), "churn_rate", "customers"
    ).filter(F.col("value").isNotNull())


def industry_kpis(df: DataFrame, measure: str, digits: int = 2, churn: str = "churn", by: Sequence[str] = ()) -> DataFrame:
    n, churned = F.count("*"), F.sum(ref(churn)).cast("bigint")
    return df.groupBy(*[ref(b) for b in by]).agg(
        n.alias("customers"),
        churned.alias("churned"),
        F.bround(F.try_divide(churned.cast("double"), n.cast("double")) * 100.0, 1).alias("churn_rate"),
        F.bround(F.avg(ref(measure)), digits).alias("average"),
    )


def union_industries(tables: Mapping[str, DataFrame], extra: bool = False) -> DataFrame:
    """Stack unlike tables with an `industry` column: the shared churn column, or all columns."""
    parts = []
    for industry, df in tables.items():
        part = df if extra else df.select("churn")
        parts.append(part.withColumn("industry", F.lit(industry)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def platform_overview(stacked: DataFrame) -> DataFrame:
    n, churned = F.count("*"), F.coalesce(F.sum("churn"), F.lit(0)).cast("bigint")
    return stacked.agg(
        n.alias("customers"),
        churned.alias("churned"),
        (n - churned).alias("retained"),
        F.coalesce(F.bround(F.try_divide(churned.cast("double"), n.cast("double")) * 100.0, 1), F.lit(0.0)).alias("churn_rate"),
    )


def preview(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first rows in a stated order; planned as a top-k, not as a full sort."""
    return df.orderBy(*[ref(o) for o in order]).limit(n)


def bulk_summary(scored: DataFrame, prediction: str = "Churn_Prediction", risk: str = "Risk_Level") -> DataFrame:
    p, r = ref(prediction), ref(risk)
    return scored.agg(
        F.count("*").alias("customers"),
        F.count_if(p == "WILL CHURN").alias("will_churn"),
        F.bround(F.try_divide(F.count_if(p == "WILL CHURN").cast("double"), F.count("*").cast("double")) * 100.0, 1).alias("churn_rate"),
        F.count_if(r.startswith("High")).alias("high"),
        F.count_if(r.startswith("Medium")).alias("medium"),
        F.count_if(r.startswith("Low")).alias("low"),
    )
