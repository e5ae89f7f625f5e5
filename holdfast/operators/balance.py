"""Class rebalancing: class weights, and synthetic minority rows between near neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash60, key_text, uniform
from ..functions.text import ref
from ..session import materialised
from .neighbours import LEAF, neighbour_vectors
from .order_stats import select_ranks

COPIES_PER_ROW = 10_000


def _class_sizes(df: DataFrame, label: str) -> DataFrame:
    """(__l, __n): the rows of each class; a null class is one.  Written first, so that the join back knows how small the table is
    and leaves the rows where they are, instead of dealing them to as many tasks as there are classes."""
    counts = df.groupBy(F.struct(ref(label).alias("l")).alias("__l")).agg(F.count("*").alias("__n"))
    return materialised(counts, "classes")


def class_weight(df: DataFrame, label: str = "label", column: str = "weight") -> DataFrame:
    """n / (classes * n_class) per row.  Counts are joined back by class, however many there are; a null class is one."""
    counts = _class_sizes(df, label)
    total = counts.agg(F.sum("__n").alias("n"), F.count("*").alias("k")).first()
    weights = counts.select("__l", (F.lit(float(total["n"] or 0)) / (F.lit(total["k"]) * F.col("__n"))).alias(column))
    return df.drop(column).withColumn("__l", F.struct(ref(label).alias("l"))).join(weights, "__l").drop("__l")


def oversample(df: DataFrame, key: str | Sequence[str], label: str = "label", seed: int = 42) -> DataFrame:
    """Rows of smaller classes repeated until classes are about equal, for models that take no weights.

    A row comes as often as its class asks for in whole numbers, and once more if its key's hash lies below the rest.
    """
    counts = _class_sizes(df, label)
    most = counts.agg(F.max("__n")).first()[0] or 0
    shares = counts.select("__l", (F.lit(float(most)) / F.col("__n")).alias("__s"))
    joined = df.withColumn("__l", F.struct(ref(label).alias("l"))).join(shares, "__l")
    copies = F.floor("__s") + F.when(uniform(key_text(key), f"over{seed}") < F.col("__s") - F.floor("__s"), 1).otherwise(0)
    return joined.withColumn("__c", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop("__l", "__s", "__c")


def smote(
    df: DataFrame,
    features: Sequence[str],
    key: str | Sequence[str],
    label: str = "label",
    k: int = 5,
    seed: int = 42,
    leaf_size: int = LEAF,
) -> DataFrame:
    """Features and label of all rows plus synthetic minority rows up to equal classes; adds `synthetic`.

    Every minority row gets the same number of synthetic rows, give or take one; which rows get the extra one
    is decided by an exact rank of their key hash.  A synthetic row lies on the segment from a minority row to
    one of its k near minority rows.  Features are numbers: vectors of levels have no points between them.
    """
    vectors = [f for f in features if df.schema[f].dataType.typeName() == "vectorudt"]
    if vectors:
        raise ValueError(f"no interpolation of {vectors}; rebalance by weights or leave these columns out")
    base = df.select(*[ref(f).cast("double").alias(f) for f in features], ref(label).cast("double").alias(label), key_text(key).alias("__key"))
    # read by the counts, the ranks, the points and the result: what it comes from is computed once
    base = materialised(base, "to-balance")
    counts = {r[label]: r["n"] for r in base.groupBy(ref(label)).agg(F.count("*").alias("n")).limit(3).collect()}
    real = base.drop("__key").withColumn("synthetic", F.lit(False))
    if len(counts) != 2:
        raise ValueError(f"two classes expected, found {len(counts)}")
    (minor, n_minor), (_, n_major) = sorted(counts.items(), key=lambda kv: kv[1])
    need = n_major - n_minor
    if need == 0:
        return real
    each, extra = divmod(need, n_minor)
    small = base.filter(ref(label) == F.lit(minor)).select(
        F.array(*[ref(f) for f in features]).alias("vec"), hash60(F.col("__key"), f"smote{seed}").alias("__h")
    )
    cut = -1
    if extra:
        cut = select_ranks(small.select("__h"), "__h", [extra - 1])[extra - 1]
    copies = F.lit(each) + F.when(F.col("__h") <= F.lit(cut), 1).otherwise(0)
    points = materialised(small.groupBy("vec").agg(F.count("*").alias("mult"), F.sum(copies).alias("copies")), "points")
    made = neighbour_vectors(points, k, leaf_size).filter((F.col("copies") > 0) & (F.size("near") > 0))
    # A value held by many rows asks for many copies: spread them over tasks before they are made.
    step = F.lit(COPIES_PER_ROW)
    parts = (
        made.withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, step.cast("bigint"))))
        .withColumn("last", F.least(F.col("first") + step, F.col("copies")) - 1)
        .select("vec", "near", "first", "last")
    )
    spread = parts.repartition(F.xxhash64("vec", "first"))
    one = spread.withColumn("copy", F.explode(F.sequence("first", "last")))
    pick = F.pmod(F.xxhash64("vec", "copy", F.lit(seed)), F.size("near").cast("bigint")).cast("int")
    gap = F.pmod(F.xxhash64("copy", "vec", F.lit(seed + 1)), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))
    drawn = one.select("vec", F.get(F.col("near"), pick).alias("to"), gap.alias("gap"))
    mixed = drawn.select(*[(F.get("vec", F.lit(i)) + F.col("gap") * (F.get("to", F.lit(i)) - F.get("vec", F.lit(i)))).alias(f) for i, f in enumerate(features)])
    synthetic = mixed.withColumn(label, F.lit(float(minor))).withColumn("synthetic", F.lit(True))
    return real.unionByName(synthetic)

