"""Target-distribution importance resampling of n-gram buckets, with a head-tail vocabulary.

Features of a text are its runs of 1 to SIZES consecutive words, joined by single spaces; a feature's bucket is the CRC-32 of
its bytes modulo BUCKETS.  A bucket's gain is floor(1000 * ln((t + 1) * (S + BUCKETS) / ((s + 1) * (T + BUCKETS)))) with its
counts s in the corpus and t in the target, a document's weight the sum of its features' gains, and its score the weight plus
Gumbel noise from a hash of its id: the highest scores are a sample without replacement in proportion to exp(weight / 1000).

1. Head: every task keeps a summary of the most frequent words (Misra-Gries with HEAD_WORDS counters, so that every word that
   makes up more than 1 in HEAD_WORDS of a task's words is in it), the summaries are added up, and the words on top go to all
   tasks with the CRC state they lead to.  The same, over pairs of head words, gives the frequent pairs.  Both tables have a
   fixed number of entries; they decide how a CRC is found, never its value.
2. Tail: a word that is not in the head gets the CRC of its own bytes.  A feature that no table has continues the state of the
   words before: the state moves over the space and the next word by tables of CRC shifts, in which the CRC is linear.
3. Totals: each task counts its features by bucket; the sums over all tasks are exact.  One row per bucket reaches the driver.
4. Weights: a second reading of the texts adds up gains.  Documents with at least `least_words` words are ranked by score over
   a range partitioning with running counts, so no task sees them all.

Defined cases: a null, empty or blank text has no features and weight 0; a null id counts as the empty string in the noise
and comes last among equal scores; rows that repeat are documents of their own, ranked in any order where they are equal;
without target or corpus texts all counts are 0; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from .common import steps, written
from .words import NOT_ALNUM, PACKED, Words, mix, packed, split_words

BUCKETS = 10_000
SIZES = 3
HEAD_WORDS = 1 << 15
HEAD_PAIRS = 1 << 16
SEED = 42

_POLYNOMIAL = 0xEDB88320
#: Lengths up to which a shift is one lookup; words up to this length are hashed side by side.
_NEAR = 64
_SPACE = np.uint32(zlib.crc32(b" "))


def _byte_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, value >> 1 ^ np.uint32(_POLYNOMIAL), value >> 1).astype(np.uint32)
    return value


_TABLE = _byte_table()


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """What n zero bytes make of each byte of a state: for n up to _NEAR, and for the powers of two."""
    one = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    near = np.empty((_NEAR + 1, 4, 256), dtype=np.uint32)
    near[0] = one
    for n in range(_NEAR):
        near[n + 1] = _TABLE[near[n] & 255] ^ near[n] >> 8
    far = np.empty((48, 4, 256), dtype=np.uint32)
    far[0] = near[1]
    for k in range(47):
        far[k + 1] = _by_bytes(far[k], far[k])
    return near, far


def _by_bytes(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    return tables[0][state & 255] ^ tables[1][state >> 8 & 255] ^ tables[2][state >> 16 & 255] ^ tables[3][state >> 24]


_SHIFT, _DOUBLE = _shift_tables()
_FLAT = np.ascontiguousarray(_SHIFT).reshape(-1)


def shifted(state: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC states after as many zero bytes."""
    at = np.minimum(size, _NEAR).astype(np.int64) * 1024
    out = _FLAT[at + (state & 255)] ^ _FLAT[at + 256 + (state >> 8 & 255)] ^ _FLAT[at + 512 + (state >> 16 & 255)] ^ _FLAT[at + 768 + (state >> 24)]
    far = np.flatnonzero(size > _NEAR)
    rest = size[far] - _NEAR
    for k in range(int(rest.max(initial=0)).bit_length()):
        on = far[(rest >> k & 1) == 1]
        out[on] = _by_bytes(_DOUBLE[k], out[on])
    return out


def continued(state: np.ndarray, word: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC of a feature from that of the words before (`state`) and that of its last word."""
    spaced = _TABLE[state & 255] ^ state >> 8 ^ _SPACE
    return shifted(spaced, size) ^ word


def direct(words: Words, which: np.ndarray) -> np.ndarray:
    """The CRC of the bytes of some words."""
    start, size = words.start[which], words.end[which] - words.start[which]
    state = np.full(len(which), 0xFFFFFFFF, dtype=np.uint32)
    short = np.flatnonzero(size <= _NEAR)
    for k in range(int(size[short].max(initial=0))):
        short = short[size[short] > k]
        state[short] = _TABLE[(state[short] ^ words.data[start[short] + k]) & 255] ^ state[short] >> 8
    state ^= np.uint32(0xFFFFFFFF)
    raw = memoryview(np.ascontiguousarray(words.data))
    for i in np.flatnonzero(size > _NEAR).tolist():
        state[i] = zlib.crc32(raw[start[i] : start[i] + size[i]])
    return state


class Table(NamedTuple):
    """An open table of exact keys: slot -> (first key, second key, value); a key that finds its slot taken is left out."""

    shift: int
    first: np.ndarray
    second: np.ndarray
    value: np.ndarray
    used: np.ndarray

    def find(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, entry) of each key."""
        at = _slot(first, second, self.shift)
        return self.used[at] & (self.first[at] == first) & (self.second[at] == second), at


def _slot(first: np.ndarray, second: np.ndarray, shift: int) -> np.ndarray:
    return (mix(mix(first) + second) >> np.uint64(shift)).astype(np.int64)


def table_of(first: np.ndarray, second: np.ndarray, value: np.ndarray) -> Table:
    """Keys in order of importance: the first one keeps a slot."""
    bits = max(8, int(4 * len(first)).bit_length())
    at, keep = np.unique(_slot(first, second, 64 - bits), return_index=True)
    out = Table(64 - bits, *(np.zeros(1 << bits, dtype=x.dtype) for x in (first, second, value)), np.zeros(1 << bits, dtype=bool))
    out.first[at], out.second[at], out.value[at], out.used[at] = first[keep], second[keep], value[keep], True
    return out


class Head(NamedTuple):
    """Word table (value: CRC) and pair table (keys: the slots of both words; value: CRC)."""

    words: Table
    pairs: Table


NO_PAIRS = table_of(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32))


def crcs(words: Words, head: Head) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2 and so on words: (place of the first word, CRC) of each run inside a document."""
    size = words.end - words.start
    known, slot = head.words.find(*packed(words))
    known &= size <= PACKED
    single = head.words.value[slot]
    tail = np.flatnonzero(~known)
    single[tail] = direct(words, tail)
    place = np.arange(len(size))
    yield place, single
    last = np.repeat(words.first[1:], np.diff(words.first))
    state = single
    for n in range(2, SIZES + 1):
        inside = place + n - 1 < last[place]
        place, state = place[inside], state[inside]
        end = place + n - 1
        if n == 2:
            both = known[place] & known[end]
            met, at = head.pairs.find(slot[place].astype(np.uint64), slot[end].astype(np.uint64))
            met &= both
            more = head.pairs.value[at]
            rest = np.flatnonzero(~met)
            more[rest] = continued(state[rest], single[end[rest]], size[end[rest]])
            state = more
        else:
            state = continued(state, single[end], size[end])
        yield place, state


class Summary:
    """Misra-Gries counts of keys of two numbers: what it leaves out makes up at most 1 in `room` of what it was given."""

    def __init__(self, room: int) -> None:
        self.room = room
        self.keys, self.counts = np.empty((0, 2), dtype=np.uint64), np.empty(0, dtype=np.int64)

    def add(self, first: np.ndarray, second: np.ndarray) -> None:
        if not len(first):
            return
        keys = np.concatenate([self.keys, np.stack([first, second], axis=1)])
        counts = np.concatenate([self.counts, np.ones(len(first), dtype=np.int64)])
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        keys, counts = keys[order], counts[order]
        edge = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
        keys, counts = keys[edge], np.add.reduceat(counts, edge)
        if len(counts) > self.room:
            counts = counts - np.partition(counts, -self.room - 1)[-self.room - 1]
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts = keys, counts

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.keys[:, 0].astype(np.int64)), pa.array(self.keys[:, 1].astype(np.int64)), pa.array(self.counts)], names=["a", "b", "n"])


def _top(found: DataFrame, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys with the largest sums, at most `room`: whole classes of sums some 9% wide, as many as fit."""
    sums = written(found.groupBy("a", "b").agg(F.sum("n").alias("n")), "frequent")
    width = F.floor(F.log2("n") * 8)
    # a row per class: some hundreds
    classes = sums.groupBy(width.alias("class")).agg(F.count("*").alias("n")).orderBy(F.col("class").desc()).toPandas()
    fit = classes["class"][classes["n"].cumsum() <= room]
    rows = sums.filter(width >= int(fit.iloc[-1]) if len(fit) else F.lit(False)).toPandas()
    rows = rows.sort_values(["n", "a", "b"], ascending=[False, True, True])
    return rows["a"].to_numpy(np.int64).view(np.uint64), rows["b"].to_numpy(np.int64).view(np.uint64)


def head_of(texts: DataFrame, words: int = HEAD_WORDS, pairs: int = HEAD_PAIRS) -> Head:
    """The frequent words and pairs of `texts` (text)."""

    def frequent_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Summary(words)
        for _, part in steps(batches):
            split = split_words(part, NOT_ALNUM, lower=True)
            short = split.end - split.start <= PACKED
            held.add(*(k[short] for k in packed(split)))
        yield held.rows()

    low, high = _top(texts.mapInArrow(frequent_words, "a long, b long, n long"), words)
    spelled = [int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little") for a, b in zip(low, high, strict=True)]
    known = table_of(low, high, np.array([zlib.crc32(s.rstrip(b"\0")) for s in spelled], dtype=np.uint32))
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def frequent_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Summary(pairs)
        for _, part in steps(batches):
            split = split_words(part, NOT_ALNUM, lower=True)
            met, slot = shared.value.find(*packed(split))
            met &= split.end - split.start <= PACKED
            last = np.repeat(split.first[1:], np.diff(split.first))[:-1]
            here = np.flatnonzero(met[:-1] & met[1:] & (np.arange(1, len(met)) < last))
            held.add(slot[here].astype(np.uint64), slot[here + 1].astype(np.uint64))
        yield held.rows()

    one, two = (x.astype(np.int64) for x in _top(texts.mapInArrow(frequent_pairs, "a long, b long, n long"), pairs))
    size = np.zeros(len(known.value), dtype=np.int64)
    size[_slot(low, high, known.shift)[::-1]] = [len(s.rstrip(b"\0")) for s in spelled[::-1]]
    return Head(known, table_of(one.view(np.uint64), two.view(np.uint64), continued(known.value[one], known.value[two], size[two])))


def bucket_totals(texts: DataFrame, head) -> np.ndarray:
    """How often the features of all `texts` (text) fall into each bucket; `head` is a broadcast Head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for _, part in steps(batches):
            for _, crc in crcs(split_words(part, NOT_ALNUM, lower=True), head.value):
                total += np.bincount(crc % np.uint32(BUCKETS), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    rows = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket."""
    big_s, big_t = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    each = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log(float(t + 1) * big_s / (float(s + 1) * big_t))) for s, t in each], dtype=np.int64)


def noise(doc_id: str | None, seed: int = SEED) -> float:
    """A Gumbel variable times 1000."""
    h = int(hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()[:8], 16)
    return -1000 * math.log(-math.log((h + 0.5) / 4294967296))


def weigh(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of `docs`."""
    texts = docs.select(F.col(text).cast("string").alias("text"))
    sc = docs.sparkSession.sparkContext
    head = sc.broadcast(head_of(texts))
    gain = sc.broadcast(gains(bucket_totals(texts, head), bucket_totals(target.select(F.col(target_text).cast("string").alias("text")), head)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data in steps(batches):
            words = split_words(data, NOT_ALNUM, lower=True)
            at_word = np.zeros(len(words.start) + 1, dtype=np.int64)
            n = np.diff(words.first)
            for place, crc in crcs(words, head.value):
                at_word[place + 1] += gain.value[crc % np.uint32(BUCKETS)]
            upto = np.cumsum(at_word)[words.first]
            weight = np.diff(upto)
            features = sum(np.maximum(n - k, 0) for k in range(SIZES))
            score = [w + math.floor(noise(i)) for w, i in zip(weight.tolist(), part.column("id").to_pylist(), strict=True)]
            columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(features, pa.int64()), pa.array(weight), pa.array(score, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    longs = StructType().add("n_words", "long").add("n_features", "long").add("weight", "long").add("score", "long")
    schema = StructType([StructField("doc_id", docs.schema[doc_id].dataType), *longs])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 5, least_words: int = 20, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row: the floor(percent * N / 100) highest scores of the N documents
    with at least `least_words` words are drawn and ranked from 1, others have no rank."""
    weighed = written(weigh(docs, target, doc_id=doc_id, text=text, target_text=target_text), "weighed")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "weight", "n_features", "salt"]
    dealt = weighed.filter(F.col("n_words") >= least_words).withColumn("salt", F.monotonically_increasing_id())
    dealt = written(dealt.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    # a row per partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    ranked = dealt.join(F.broadcast(before), "part").withColumn("rank", place.cast("long"))
    rank = F.when(F.col("rank") <= F.expr(f"all * {int(percent)} div 100"), F.col("rank"))
    kept = ["doc_id", "n_features", "weight", "score"]
    short = weighed.filter(F.col("n_words") < least_words).select(*kept, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*kept, rank.alias("rank")).unionByName(short)
