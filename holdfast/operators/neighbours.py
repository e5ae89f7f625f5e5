"""k near neighbours among the rows of a table, by a forest of random projections.

A tree cuts the points at quantiles of their projection on a random direction, level after level, until a cell has `leaf`
points at most; inside a cell distances are computed.  Cells of different trees cut the space differently, so a neighbour that
one tree separates another one keeps.  Trees come in batches until a batch changes the neighbours of few points only, and each
point keeps the k nearest of all cells it was in.  Distances are exact; neighbours are those with a small chance of missing
one, and all of them where the points fit one cell.

Equal points are combined beforehand, so a value held by much of the table is one point with a multiplicity.  No group is
larger than about a cell, and the driver sees the number of points and the share of changed ones only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialised

LEAF = 1024
TREES = 8
#: Batches of trees at most, and the share of changed points at which a further one is not worth it.
BATCHES = 8
SETTLED = 0.05
#: Children of a cell in one level.
FAN = 16
#: Cells whose cuts are sent to all tasks instead of being joined by a shuffle.
FEW_CELLS = 10_000

_NEAR = "array<struct<d: double, id: bigint>>"
_FOUND = "array<struct<d: double, m: bigint, v: array<double>>>"


def _projected(points: DataFrame, trees: int, levels: int, seed: int) -> DataFrame:
    """(id, tree, p): the projections of each point on the directions of each tree's levels."""

    def project(parts):
        import numpy as np
        import pyarrow as pa

        ways = None
        for part in parts:
            if not part.num_rows:
                continue
            x = _matrix(part.column("vec"), part.num_rows)
            if ways is None:
                ways = np.random.default_rng(seed).normal(size=(x.shape[1], trees * levels))
            p = pa.FixedSizeListArray.from_arrays(pa.array((x @ ways).reshape(-1)), levels).cast(pa.list_(pa.float64()))
            columns = [pa.array(np.repeat(part.column("id").to_numpy(), trees)), pa.array(np.tile(np.arange(trees, dtype=np.int32), len(x))), p]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "tree", "p"])

    return points.select("id", "vec").mapInArrow(project, "id bigint, tree int, p array<double>")


def _matrix(column, rows: int):
    """A column of vectors of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def cells(points: DataFrame, n: int, trees: int, leaf: int, seed: int) -> DataFrame:
    """(id, tree, cell) for `n` points (id, vec)."""
    levels = max(0, math.ceil(math.log(max(1.0, n / leaf), FAN)))
    if not levels:
        return points.select("id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(0).cast("bigint").alias("cell"))
    placed = materialised(_projected(points, trees, levels, seed).withColumn("cell", F.lit(0).cast("bigint")), "projections")
    shares = [i / FAN for i in range(1, FAN)]
    for level in range(levels):
        p = F.get("p", F.lit(level))
        cuts = placed.groupBy("tree", "cell").agg(F.count("*").alias("n"), F.percentile_approx(p, shares, 1000).alias("cuts")).filter(F.col("n") > leaf)
        cuts = materialised(cuts, "cuts")
        parts = F.least(F.lit(FAN), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / leaf)))).cast("int")
        below = F.size(F.filter("cuts", lambda c: c < p))
        child = F.coalesce(F.floor(below / (FAN / parts)).cast("bigint"), F.lit(0))
        joined = placed.join(F.broadcast(cuts) if cuts.count() <= FEW_CELLS else cuts, ["tree", "cell"], "left")
        placed = joined.select("id", "tree", "p", (F.col("cell") * FAN + child).alias("cell"))
    return placed.select("id", "tree", "cell")


def _nearest_in_cell(k: int):
    def search(cell):
        import numpy as np
        import pyarrow as pa

        cell = cell.combine_chunks().sort_by("id")
        ids, x = cell.column("id").to_numpy(), _matrix(cell.column("vec").combine_chunks(), cell.num_rows)
        # half the width is enough to choose some more than k
        short = x.astype(np.float32)
        square = (short**2).sum(axis=1)
        take = min(k + 4, len(x) - 1)
        far, of = [], []
        step = max(1, 2_000_000 // len(x))
        for first in range(0, len(x), step):
            q = x[first : first + step]
            d2 = square[first : first + step, None] + square - 2 * short[first : first + step] @ short.T
            d2[np.arange(len(q)), np.arange(first, first + len(q))] = np.inf
            some = np.argpartition(d2, take - 1, axis=1)[:, :take] if take else np.empty((len(q), 0), dtype=np.int64)
            # the sum of squares again, so that a pair has the same distance in every cell
            exact = ((x[some] - q[:, None]) ** 2).sum(axis=2)
            order = np.lexsort((ids[some], exact), axis=1)[:, :k]
            far.append(np.take_along_axis(exact, order, axis=1))
            of.append(ids[np.take_along_axis(some, order, axis=1)])
        far, of = np.concatenate(far), np.concatenate(of)
        pairs = pa.StructArray.from_arrays([pa.array(far.reshape(-1)), pa.array(of.reshape(-1))], names=["d", "id"])
        near = pa.ListArray.from_arrays(pa.array(np.arange(0, far.size + 1, far.shape[1], dtype=np.int32)) if far.shape[1] else pa.array(np.zeros(len(x) + 1, dtype=np.int32)), pairs)
        return pa.table({"id": pa.array(ids), "near": near})

    return search


def nearest(points: DataFrame, k: int, leaf_size: int = LEAF, seed: int = 42) -> DataFrame:
    """`points` has distinct `vec array<double>` and `mult bigint`.  Returns vec and `found`: up to k near other points as
    (squared distance, mult, vector), ordered by distance, then by a hash of the vector."""
    known = materialised(points.select(F.xxhash64("vec").alias("id"), "vec", "mult"), "points")
    n = known.count()
    best: DataFrame | None = None
    for batch in range(BATCHES):
        placed = cells(known, n, TREES if n > leaf_size else 1, leaf_size, seed + batch)
        found = placed.join(known.select("id", "vec"), "id").groupBy("tree", "cell").applyInArrow(_nearest_in_cell(k), f"id bigint, near {_NEAR}")
        every = found if best is None else found.unionByName(best.select("id", "near"))
        # a pair found in several cells stands next to itself after sorting
        merged = every.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("near"))).alias("all"))
        merged = merged.select("id", F.slice(F.filter("all", lambda x, i: (i == 0) | (x != F.get("all", i - 1))), 1, k).alias("near"))
        before, best = best, materialised(merged, "near")
        if n <= leaf_size:
            break
        if before is not None:
            changed = best.join(before.withColumnRenamed("near", "old"), "id").agg(F.count_if(F.col("near") != F.col("old"))).first()[0]
            if changed <= SETTLED * n:
                break
    pairs = best.select("id", F.explode("near").alias("x")).select(F.col("id").alias("of"), "x.d", "x.id")
    named = pairs.join(known.select("id", F.col("mult").alias("m"), F.col("vec").alias("v")), "id")
    lists = named.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("d", "id", "m", "v"))).alias("found"))
    short = F.transform("found", lambda f: F.struct(f["d"].alias("d"), f["m"].alias("m"), f["v"].alias("v")))
    return known.join(lists, F.col("id") == F.col("of"), "left").select("vec", short.alias("found"))


def neighbour_vectors(points: DataFrame, k: int, leaf_size: int = LEAF) -> DataFrame:
    """vec, mult and `near`: k neighbour vectors of a row with that value, equal rows counting first."""
    found = nearest(points.select("vec", "mult"), k, leaf_size)
    joined = points.join(found, "vec")
    twins = F.array_repeat(F.col("vec"), F.least(F.col("mult") - 1, F.lit(k)).cast("int"))
    others = F.flatten(F.transform(F.coalesce("found", F.array().cast(_FOUND)), lambda f: F.array_repeat(f["v"], F.least(f["m"], F.lit(k)).cast("int"))))
    return joined.withColumn("near", F.slice(F.concat(twins, others), 1, k)).drop("found")
