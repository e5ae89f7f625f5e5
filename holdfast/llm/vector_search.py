"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors are scaled by the longest norm and given one more coordinate that makes all of length one; queries are scaled to
length one with a zero there.  Then the largest inner product is the least distance, for which p-stable hashing is made: TABLES
tables of HASHES functions floor((a.x + b) / WIDTH) with Gaussian a.  In each table a query visits its own bucket and those
perturbed by one step in some functions, in the order of the summed squared distances to the crossed boundaries, which is the
order of the estimated chance to succeed.  Candidates of all tables are merged and reranked exactly on the original vectors.

How many buckets to visit is fitted: for at most SAMPLE queries the true neighbours are found by brute force together with
the visit at which each would be reached; the number of visits is the smallest that reaches RECALL of them.  Steps of one per
function reach only so far: where no number of visits reaches RECALL, as with norms of very different sizes, all queries are
answered by brute force, and so is any query whose visits led to fewer than k candidates, over all shards.

Vectors lie in shards by hash and queries in blocks, each of a bounded number of bytes; shards and blocks meet by a join on
the shard, and what comes out are the best k of a block's queries in a shard.  A frequent vector is spread over all shards.

Defined cases: vectors that are null, zero, of another length than most (ties to the shorter), or with null or non-finite
components take no part, as do rows without an id; ties go to the smaller id; rows that repeat an id are one candidate each,
none of them for a query of the same id; a query with fewer candidates than k gets them all; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

TABLES = 16
HASHES = 6
WIDTH = 1.4
RECALL = 0.96
SAMPLE = 128
BLOCK_BYTES = 4 << 20
SHARD_ROWS = 8192
QUERY_ROWS = 512
#: Rounding that a fast product may differ by from the exact one.
SLACK = 1e-9


@lru_cache(maxsize=2)
def functions(dim: int, tables: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, offsets and odd multipliers that turn a bucket's numbers into one code; the same in every task."""
    rng = np.random.default_rng(20_240_601)
    a, b = rng.normal(size=(tables, dim + 1, hashes)), rng.uniform(0, width, size=(tables, hashes))
    codes = rng.integers(1, 1 << 62, size=hashes, dtype=np.int64) | 1
    return a, b, codes


@lru_cache(maxsize=2)
def perturbations(hashes: int) -> np.ndarray:
    return np.array(list(itertools.product((-1, 0, 1), repeat=hashes)), dtype=np.int64)


class Hasher:
    def __init__(self, dim: int, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH) -> None:
        self.a, self.b, self.codes = functions(dim, tables, hashes, width)
        self.width, self.tables, self.moves = width, tables, perturbations(hashes)

    def places(self, table: int, x: np.ndarray) -> np.ndarray:
        return (x @ self.a[table] + self.b[table]) / self.width

    def buckets(self, table: int, x: np.ndarray) -> np.ndarray:
        return np.floor(self.places(table, x)).astype(np.int64) @ self.codes

    def probes(self, table: int, x: np.ndarray, visits: int) -> np.ndarray:
        """Codes of the first `visits` buckets of each query, in order."""
        f = self.places(table, x)
        low = np.floor(f)
        r = f - low
        cost = np.stack([r**2, np.zeros_like(r), (1 - r) ** 2], axis=2)
        total = np.zeros((len(x), len(self.moves)))
        for j in range(f.shape[1]):
            total += cost[:, j, self.moves[:, j] + 1]
        visits = min(visits, len(self.moves))
        order = np.argsort(total, axis=1, kind="stable")[:, :visits]
        home = low.astype(np.int64) @ self.codes
        return home[:, None] + (self.moves @ self.codes)[order]


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    x = x / longest
    rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))
    return np.concatenate([x, rest[:, None]], axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.sqrt((x * x).sum(axis=1))[:, None]
    return np.concatenate([x, np.zeros((len(x), 1))], axis=1)


def usable(embedding: Column) -> Column:
    ok = F.forall(embedding, lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")), F.lit(False)))
    return embedding.isNotNull() & (F.size(embedding) > 0) & F.coalesce(ok, F.lit(False)) & F.exists(embedding, lambda x: x != 0)


def packed(rows: DataFrame, group: str) -> DataFrame:
    """A row per group: ids, rows (a hash of the vector) and vectors as bytes."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        ids, row = (t.column(c).to_numpy().astype("<i8") for c in ("vec_id", "row"))
        order = np.lexsort((row, ids))
        flat = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(ids), -1)
        columns = {"ids": ids[order], "rows": row[order], "vectors": flat[order]}
        return pa.table({group: pa.array([key[0].as_py()], pa.int32()), **{c: pa.array([v.tobytes()], pa.binary()) for c, v in columns.items()}})

    return rows.groupBy(group).applyInArrow(run, f"{group} int, ids binary, rows binary, vectors binary")


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search_block(hasher: Hasher, q_ids: np.ndarray, q_rows: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, longest: float, k: int, visits: int, exhaustive: bool):
    """(query, its row, id, score, visit) of the best k of each query among its candidates (all vectors, if exhaustive; without visits
    nothing is hashed then)."""
    lifted_v, unit_q = lifted(vectors, longest), unit(queries)
    never = np.int32(1 << 30)
    reached = np.full((len(q_ids), len(ids)), never, dtype=np.int32) if exhaustive else np.zeros((len(q_ids), len(ids)), dtype=bool)
    for t in range(hasher.tables if visits else 0):
        present, which = np.unique(hasher.buckets(t, lifted_v), return_inverse=True)
        probes = hasher.probes(t, unit_q, visits)
        at = np.minimum(np.searchsorted(present, probes), len(present) - 1)
        row, visit = np.nonzero(present[at] == probes)
        if exhaustive:
            first = np.full((len(q_ids), len(present)), never, dtype=np.int32)
            np.minimum.at(first, (row, at[row, visit]), visit.astype(np.int32))
            np.minimum(reached, first[:, which], out=reached)
        else:
            seen = np.zeros((len(q_ids), len(present)), dtype=bool)
            seen[row, at[row, visit]] = True
            reached |= seen[:, which]
    for i in range(len(q_ids)):
        found = np.flatnonzero(ids != q_ids[i]) if exhaustive else np.flatnonzero(reached[i] & (ids != q_ids[i]))
        if not len(found):
            continue
        own = vectors[found]
        if len(found) > k:
            quick = own @ queries[i]
            close = quick >= np.partition(quick, len(quick) - k)[len(quick) - k] - SLACK * max(1.0, float(np.abs(quick).max()))
            found, own = found[close], own[close]
        exact = (own * queries[i]).sum(axis=1)
        best = top(exact, ids[found], k)
        yield from zip(itertools.repeat(int(q_ids[i])), itertools.repeat(int(q_rows[i])), ids[found[best]].tolist(), exact[best].tolist(), reached[i, found[best]].tolist())


def met(shards: DataFrame, blocks: DataFrame, n_shards: int, dim: int, longest: float, k: int, visits: int, exhaustive: bool) -> DataFrame:
    """(query_id, row, vec_id, score, visit): the best k of each query in each shard."""
    everywhere = blocks.select(F.col("block"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"))
    pairs = shards.drop("rows").join(everywhere.repartition("shard"), "shard").drop("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(dim)
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row].as_buffer() for c in ("ids", "vectors", "q_ids", "q_rows", "q_vectors")}
                read = lambda c, kind: np.frombuffer(one[c], dtype=kind)  # noqa: B023, E731
                found = list(search_block(hasher, read("q_ids", "<i8"), read("q_rows", "<i8"), read("q_vectors", "<f8").reshape(-1, dim), read("ids", "<i8"), read("vectors", "<f8").reshape(-1, dim), longest, k, visits, exhaustive))
                columns = list(zip(*found, strict=True)) if found else [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([int(x) if kind != pa.float64() else x for x in c], kind) for c, kind in zip(columns, kinds, strict=True)], names=["query_id", "row", "vec_id", "score", "visit"])

    return pairs.mapInArrow(run, "query_id long, row long, vec_id long, score double, visit int")


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, row (a hash of its vector), rank, vec_id, score: the nearest k found for each different row (id and vector) with
    `is_query` (a condition on vec_id)."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).filter("vec_id is not null").filter(usable(F.col("embedding")))
    rows = rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")).withColumn("row", F.xxhash64("embedding"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    lengths = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("longest"), F.count(F.when(is_query, 1)).alias("queries"))
    kind = lengths.orderBy(F.col("n").desc(), "dim").first()
    if kind is None or not kind["queries"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, row long, rank int, vec_id long, score double")
    dim, longest = kind["dim"], float(kind["longest"])
    rows = rows.filter(F.size("embedding") == dim)
    per = lambda most: max(64, min(most, BLOCK_BYTES // (8 * dim)))
    n_shards, n_blocks = -(-kind["n"] // per(SHARD_ROWS)), -(-kind["queries"] // per(QUERY_ROWS))
    spread = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(n)).cast("int")
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(1), "vec_id", "embedding"), F.lit(n_shards)).cast("int"))
    shards = written(packed(dealt, "shard"), "vector_shards")
    # a query given twice is one
    asked = rows.filter(is_query).dropDuplicates(["vec_id", "row"]).withColumn("block", spread(2, n_blocks))
    blocks = written(packed(asked, "block"), "vector_queries")
    visits = 0
    if kind["n"] > k + 1:
        share = min(1.0, sample / kind["queries"])
        few = asked.filter(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 20)) <= int(share * (1 << 20))).withColumn("block", F.lit(0))
        most = len(perturbations(HASHES))
        true = best_of(met(shards, packed(few, "block"), n_shards, dim, longest, k, most, True), k)
        seen = np.sort(np.array([r["visit"] for r in true.select("visit").collect()], dtype=np.int64))
        needed = int(seen[min(len(seen) - 1, int(np.ceil(recall * len(seen))))]) + 1 if len(seen) else most
        visits = needed if needed <= most else 0
    found = best_of(met(shards, blocks, n_shards, dim, longest, k, visits, not visits), k)
    if visits:
        found = completed(written(found, "vector_found"), asked, rows, shards, n_shards, dim, longest, k, kind["n"], per(QUERY_ROWS))
    return found.select("query_id", "row", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def completed(
    found: DataFrame, asked: DataFrame, every: DataFrame, shards: DataFrame, n_shards: int, dim: int, longest: float, k: int, n: int, block_rows: int
) -> DataFrame:
    """`found` with the queries that have fewer rows than k and than candidates answered by brute force."""
    own = every.join(asked.select("vec_id").distinct(), "vec_id", "left_semi").groupBy("vec_id").agg(F.count("*").alias("m"))
    rows = found.groupBy(F.col("query_id").alias("vec_id"), "row").agg(F.count("*").alias("rows"))
    few = F.coalesce("rows", F.lit(0)) < F.least(F.lit(k), F.lit(n) - F.col("m"))
    keyed = asked.select("vec_id", "row").join(own, "vec_id").join(rows, ["vec_id", "row"], "left")
    short = written(keyed.filter(few).select("vec_id", "row"), "vector_short")
    count = short.count()
    if not count:
        return found
    n_blocks = -(-count // block_rows)
    again = asked.join(short, ["vec_id", "row"], "left_semi").withColumn("block", F.pmod(F.xxhash64(F.lit(4), "vec_id"), F.lit(n_blocks)).cast("int"))
    exact = best_of(met(shards, written(packed(again, "block"), "vector_queries"), n_shards, dim, longest, k, 0, True), k)
    return found.join(short.select(F.col("vec_id").alias("query_id"), "row"), ["query_id", "row"], "left_anti").unionByName(exact)
