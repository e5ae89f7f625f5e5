"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_scored(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ("risk_level",), mode: str = "overwrite") -> None:
    """Scored rows, one directory per risk level; files keep the task layout, no extra shuffle."""
    writer = df.write.mode(mode)
    present = [c for c in partition_by if c in df.columns]
    if present:
        writer = writer.partitionBy(*present)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A metric table has one row per model: a single file is what readers expect."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_log(entries: DataFrame, path: str) -> None:
    """Append to the prediction log, partitioned by day so that readers prune by date."""
    entries.write.mode("append").partitionBy("date").parquet(path)
