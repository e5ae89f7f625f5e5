"""Stratified splits and folds chosen by a hash of the row key.

By default the hash value at the wanted rank of each label is found first (an exact order statistic) and joined back by
label; `exact=False` compares the hash with a threshold, without a shuffle.  Either way a recomputed partition decides alike,
and rows that share a key stay on the same side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash60, key_text, uniform
from ..functions.text import ref
from ..session import materialised
from .order_stats import cut_table


def _cuts_joined(df: DataFrame, label: str, wanted: list[Column]) -> DataFrame:
    """`df` with `__cuts`, the values of `__h` at the wanted ranks of its label.  One row per label is joined back.

    The cuts are written first: then the join knows how small they are and does not deal rows to one task per label.
    """
    cuts = cut_table(df.select(ref(label), "__h"), "__h", label, wanted).select(F.struct(ref(label).alias("l")).alias("__l"), F.col("cuts").alias("__cuts"))
    cuts = materialised(cuts, "label-cuts")
    keyed = df.withColumn("__l", F.struct(ref(label).alias("l")))
    return keyed.join(cuts, "__l", "left").drop("__l")


def stratified_split(
    df: DataFrame, key: str | Sequence[str], label: str, test_size: float = 0.2, seed: int = 42, exact: bool = True, column: str = "is_test"
) -> DataFrame:
    """Adds a boolean column: true for the test side.

    The default takes the same share of every label, to within one key; `exact=False` compares the key's hash with the
    share, which meets the shares in expectation and needs no shuffle.
    """
    if not exact:
        return df.withColumn(column, uniform(key_text(key), seed) < F.lit(test_size))
    hashed = df.withColumn("__h", hash60(key_text(key), seed))
    size = F.floor(F.col("total") * F.lit(test_size) + 0.5).cast("bigint")
    joined = _cuts_joined(hashed, label, [size - 1])
    return joined.withColumn(column, F.coalesce(F.col("__h") <= F.col("__cuts")[0], F.lit(False))).drop("__h", "__cuts")


def kfold_assign(
    df: DataFrame, key: str | Sequence[str], k: int = 5, seed: int = 42, label: str | None = None, exact: bool | None = None, column: str = "fold"
) -> DataFrame:
    """Fold number 0..k-1; with a label the folds of every label are balanced to within one key, unless `exact=False`."""
    if exact is None:
        exact = label is not None
    if not exact:
        return df.withColumn(column, F.floor(uniform(key_text(key), f"fold{seed}") * F.lit(k)).cast("int"))
    if label is None:
        raise ValueError("exact folds need the label column")
    hashed = df.withColumn("__h", hash60(key_text(key), f"fold{seed}"))
    ends = [F.floor(F.col("total") * (i + 1) / k).cast("bigint") - 1 for i in range(k - 1)]
    if not ends:
        return df.withColumn(column, F.lit(0))
    joined = _cuts_joined(hashed, label, ends)
    fold = F.size(F.filter("__cuts", lambda c: F.col("__h") > F.coalesce(c, F.lit(-1).cast("bigint"))))
    return joined.withColumn(column, fold.cast("int")).drop("__h", "__cuts")


def split_counts(df: DataFrame, label: str, side: str = "is_test") -> DataFrame:
    return df.groupBy(ref(label), ref(side)).agg(F.count("*").alias("n"))
