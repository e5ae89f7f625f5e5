"""Benchmark decontamination by Wu-Manber search over words.

A window is `width` consecutive words of a benchmark item; an item of fewer words, but not none, is one window.
Windows of one length share a shift table over blocks of two words (one, if the window is a single word): a block
that no window holds lets the search skip ahead by almost a window, a block that some window holds at a distance
from its end by that distance.  Only a shift of zero opens the bucket of windows with that last block, narrowed by
the first block; the words themselves are then compared.

The benchmark is taken in blocks of at most `block_items` items and `block_words` words (one longer item is a block
of its own), so what a task holds has a stated bound; a larger benchmark is searched block after block, with the
rows written in between.  Documents are never shuffled.

Defined cases: a null or empty text has no words; an item without words has no windows; an item with a null id marks
words but is not listed; repeated items count once; repeated documents are judged row by row; other columns stay as
they are, and a column whose name clashes with a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sha_list, steps, written
from .words import NOT_ALNUM, mix, split_words, word_hashes

WIDTH = 10
BLOCK_ITEMS = 20_000
BLOCK_WORDS = 1_000_000

_FOUND = ("n_words", "hits", "items")


def found_fields(ids: T.DataType) -> list[T.StructField]:
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return [T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(span)), T.StructField("items", T.ArrayType(ids))]


_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Table(NamedTuple):
    """Windows of one length: shifts by block, and buckets by (last block, first block) of (words, item ids)."""

    length: int
    block: int
    shift: np.ndarray
    buckets: dict[tuple[int, int], list[tuple[tuple[bytes, ...], list]]]


def block_hashes(hashes: np.ndarray, block: int) -> np.ndarray:
    return hashes if block == 1 else mix(hashes[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[1:])


def build_tables(items: list[tuple[int | str | None, bytes]], width: int) -> list[Table]:
    words = split_words([t for _, t in items], NOT_ALNUM, lower=True)
    hashes, raw = word_hashes(words), words.data.tobytes()
    windows: dict[int, dict[tuple[bytes, ...], tuple[int, set]]] = {}
    for k, (item, _) in enumerate(items):
        a, b = int(words.first[k]), int(words.first[k + 1])
        length = min(width, b - a)
        own = [raw[s:e] for s, e in zip(words.start[a:b].tolist(), words.end[a:b].tolist(), strict=True)]
        for i in range(b - a - length + 1) if length else ():
            at = windows.setdefault(length, {}).setdefault(tuple(own[i : i + length]), (a + i, set()))
            at[1].update([] if item is None else [item])
    tables = []
    for length, found in sorted(windows.items()):
        block = min(2, length)
        last = length - block
        size = 1 << max(16, int(16 * len(found) * (last + 1) - 1).bit_length())
        shift = np.full(size, last + 1, dtype=np.int16)
        blocks = block_hashes(hashes, block)
        places = np.array([at for at, _ in found.values()])
        for j in range(last + 1):
            np.minimum.at(shift, (blocks[places + j] & np.uint64(size - 1)).astype(np.int64), last - j)
        buckets: dict = {}
        for text, (at, ids) in found.items():
            buckets.setdefault((int(blocks[at + last]), int(blocks[at])), []).append((text, sorted(ids)))
        tables.append(Table(length, block, shift, buckets))
    return tables


def search(tables: list[Table], texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], list]]:
    """For each text: number of words, hit runs of words, items with an occurrence."""
    words = split_words(texts, NOT_ALNUM, lower=True)
    hashes, raw = word_hashes(words), words.data.tobytes()
    first = words.first.tolist()
    hits: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    for length, block, shift, buckets in tables:
        last = length - block
        if len(hashes) < length:
            continue
        blocks = block_hashes(hashes, block)
        shifts = shift[(blocks & np.uint64(len(shift) - 1)).astype(np.int64)]
        open_docs = np.unique(np.searchsorted(words.first, np.flatnonzero(shifts == 0), side="right") - 1)
        for d in open_docs.tolist():
            a, b = first[d], first[d + 1]
            jumps, at, end = shifts[a : max(a, b - block + 1)].tolist(), last, b - a - block + 1
            while at < end:
                if jumps[at]:
                    at += jumps[at]
                    continue
                w = a + at - last
                for text, ids in buckets.get((int(blocks[a + at]), int(blocks[w])), ()):
                    if all(raw[words.start[w + k] : words.end[w + k]] == x for k, x in enumerate(text)):
                        hits[d].append((w - a, w - a + length))
                        items[d].update(ids)
                at += 1
    for d in range(len(texts)):
        yield first[d + 1] - first[d], merged(hits[d]), sorted(items[d])


def merged(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def id_type(benchmark: DataFrame, item_id: str) -> T.DataType:
    """Whole numbers stay numbers, other ids are text."""
    return T.LongType() if isinstance(benchmark.schema[item_id].dataType, T.IntegralType) else T.StringType()


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_items: int, block_words: int) -> Iterator[list[tuple[int | str | None, bytes]]]:
    """The items in blocks of bounded size, streamed to the driver partition by partition."""
    rows = benchmark.select(F.col(item_id).cast(id_type(benchmark, item_id)).alias("i"), F.col(text).cast("string").alias("t")).filter("t is not null").distinct()
    block: list[tuple[int | str | None, bytes]] = []
    held = 0
    for row in rows.toLocalIterator():
        data = row["t"].encode()
        size = len(data) // 2 + 1
        if block and (len(block) >= block_items or held + size > block_words):
            yield block
            block, held = [], 0
        block.append((row["i"], data))
        held += size
    yield block


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH,
    block_items: int = BLOCK_ITEMS, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """`docs` with n_words, hits (runs of words inside an occurrence, end exclusive) and items (ids, ascending)."""
    df = docs.drop(*_FOUND)
    ids = id_type(benchmark, item_id)
    for k, block in enumerate(item_blocks(benchmark, item_id, item_text, block_items, block_words)):
        if k:
            df = written(df, "decontaminate")
        df = _pass(df, block, text, width, ids)
    return df


def _pass(df: DataFrame, block: list[tuple[int | str | None, bytes]], text: str, width: int, ids: T.DataType) -> DataFrame:
    earlier = "items" in df.columns and "hits" in df.columns and "n_words" in df.columns
    kept = [c for c in df.columns if not (earlier and c in _FOUND)]
    schema = T.StructType([df.schema[c] for c in kept] + found_fields(ids))
    listed = pa.list_(pa.int64() if ids == T.LongType() else pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = build_tables(block, width)
        for part, texts in steps(batches, text):
            found = list(search(tables, texts))
            if earlier:
                before = zip(part.column("hits").to_pylist(), part.column("items").to_pylist(), strict=True)
                found = [
                    (n, merged(hits + [(h["start"], h["end"]) for h in old]), sorted({*items, *more}))
                    for (n, hits, items), (old, more) in zip(found, before, strict=True)
                ]
            columns = [part.column(c) for c in kept]
            columns.append(pa.array([n for n, _, _ in found], pa.int64()))
            columns.append(pa.array([[{"start": a, "end": b} for a, b in hits] for _, hits, _ in found], _HITS))
            columns.append(pa.array([items for _, _, items in found], listed))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *_FOUND])

    return df.mapInArrow(run, schema)


def n_hit(hits: str = "hits") -> F.Column:
    return F.aggregate(F.col(hits), F.lit(0).cast("long"), lambda s, h: s + h["end"] - h["start"])


def digest(found: DataFrame) -> DataFrame:
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), sha_list(ids).alias("items_sha256"),
        (n_hit() > 0).alias("contaminated"),
    )
