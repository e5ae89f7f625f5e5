"""Substring dedup over windows of words, partitioned by super-k-mers.

The minimiser of a window is the least hash among its runs of SEED words.  Consecutive windows with the same minimiser form
one stretch of words, which travels as one packed string to the bucket of that minimiser; equal windows have equal
minimisers and so meet there.  In a bucket, rows come sorted by document; sorting the windows by content puts the first
document that holds each in front, and every later one is marked.  Marked windows go back to their documents as runs of words.

Before the shuffle a task keeps, of equal stretches, only the one of the smallest document and marks the others itself, so
copies that lie together are not sent.  What a bucket's task holds are the distinct windows of one bucket; other rows stream.

Defined cases: null or empty texts have no words; a document shorter than a window keeps all; a window repeated inside one
document, or in rows with an equal doc_id, is no repetition; rows without a doc_id are left whole and mark nothing; rows that
repeat (doc_id, text) get equal results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, binary_parts, steps
from .words import SPACES, Words, split_words, window_hashes, word_hashes, words_between

WIDTH = 13
SEED = 3
JUDGE_ROWS = 10_000
#: Bytes of text that one blob per target gathers; fewer, larger blobs compress better.
SEND_BYTES = 3 << 20
_LEVEL = 6

_BLOBS = "target int, size long, blob binary"
_ROWS = "bucket long, doc_id long, row long, start long, stop long, packed binary"
_MARKS = "doc_id long, row long, start long, end long"


def minimisers(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """The least seed hash of each window."""
    seeds = window_hashes(hashes, seed)
    n = len(hashes) - width + 1
    least = seeds[:n].copy()
    for k in range(1, width - seed + 1):
        np.minimum(least, seeds[k : k + n], out=least)
    return least


def stretches(words: Words, hashes: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first and last window (as word positions) and minimiser of each run of windows that share it."""
    nothing = np.empty(0, dtype=np.int64)
    if len(hashes) < width:
        return nothing, nothing, nothing, nothing.astype(np.uint64)
    least = minimisers(hashes, width, seed)
    doc = np.searchsorted(words.first, np.arange(len(least)), side="right") - 1
    inside = np.arange(len(least)) + width <= words.first[doc + 1]
    at = np.flatnonzero(inside)
    if not len(at):
        return nothing, nothing, nothing, nothing.astype(np.uint64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return doc[at[first]], at[first], at[last], least[at[first]]


def send(batches: Iterator[pa.RecordBatch], width: int, seed: int, targets: int) -> Iterator[pa.RecordBatch]:
    """A compressed blob per target with the stretches of the buckets that it holds."""
    codec = pa.Codec("zstd", compression_level=_LEVEL)
    for part, texts in steps(batches, "text", SEND_BYTES):
        ids, rows = part.column("doc_id").to_numpy(zero_copy_only=False), part.column("row").to_numpy(zero_copy_only=False)
        words = split_words(texts, SPACES)
        raw = words.data.tobytes()
        doc, first, last, least = stretches(words, word_hashes(words), width, seed)
        if not len(doc):
            continue
        begin, end = words.start[first], words.end[last + width - 1]
        packed = [raw[a:b] + b" " for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        start, stop = first - words.first[doc], last - words.first[doc] + width
        del raw, words, texts
        # of equal stretches in this step, the smallest document's goes on; the others are marked without their words
        own = ids[doc].tolist()
        owner: dict[bytes, int] = {}
        for p, d in zip(packed, own, strict=True):
            if owner.setdefault(p, d) > d:
                owner[p] = d
        packed = [p if owner[p] == d else b"" for p, d in zip(packed, own, strict=True)]
        del owner
        target = (least >> np.uint64(32)) % np.uint64(targets)
        order = np.argsort(target, kind="stable")
        edges = np.searchsorted(target[order], np.arange(targets + 1))
        blobs, sizes, filled = [], [], []
        for t in np.flatnonzero(np.diff(edges)).tolist():
            at = order[edges[t] : edges[t + 1]]
            names, which = np.unique(doc[at], return_inverse=True)
            strings = [packed[i] for i in at.tolist()]
            head = np.array([len(at), len(names)], dtype="<i8")
            columns = (head, ids[names].astype("<i8"), rows[names].astype("<i8"), (least[at] & np.uint64(0xFFFFFFFF)).astype("<u4"), which.astype("<u4"))
            columns += (start[at].astype("<u4"), (stop - start)[at].astype("<u4"), np.fromiter(map(len, strings), dtype="<u4", count=len(at)))
            plain = b"".join([c.tobytes() for c in columns] + strings)
            blobs.append(codec.compress(plain, asbytes=True))
            sizes.append(len(plain))
            filled.append(t)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], names=["target", "size", "blob"])


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of each blob as rows."""
    codec = pa.Codec("zstd")
    for batch in batches:
        for i in range(batch.num_rows):
            plain = codec.decompress(batch.column(2)[i].as_buffer(), decompressed_size=batch.column(1)[i].as_py(), asbytes=True)
            n, docs = np.frombuffer(plain, dtype="<i8", count=2).tolist()
            at = 16
            parts = []
            for count, kind in ((docs, "<i8"), (docs, "<i8"), *[(n, "<u4")] * 5):
                parts.append(np.frombuffer(plain, dtype=kind, count=count, offset=at))
                at += count * np.dtype(kind).itemsize
            ids, rows, bucket, which, start, length, size = parts
            packed = binary_column(np.frombuffer(plain, dtype=np.uint8, offset=at), np.concatenate([[0], np.cumsum(size, dtype=np.int64)]))
            start = start.astype(np.int64)
            columns = [bucket.astype(np.int64), ids[which], rows[which], start, start + length.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), packed], names=["bucket", "doc_id", "row", "start", "stop", "packed"])


class Seen:
    """Windows of the bucket that continues from one batch into the next: hash -> first document."""

    def __init__(self) -> None:
        self.bucket: int | None = None
        self.hashes = np.empty(0, dtype=np.uint64)
        self.docs = np.empty(0, dtype=np.int64)


def judge(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, doc_id) -> runs of words of documents that are not the first with them."""
    seen = Seen()
    for batch in batches:
        for first in range(0, batch.num_rows, JUDGE_ROWS):
            part = batch.slice(first, JUDGE_ROWS)
            c = {name: part.column(name).to_numpy(zero_copy_only=False) for name in ("bucket", "doc_id", "row", "start", "stop")}
            data, offsets = binary_parts(part.column("packed"))
            late = np.diff(offsets) == 0
            out = [(c["doc_id"][late], c["row"][late], c["start"][late], c["stop"][late])]
            if not late.all():
                bounds = np.append(offsets[:-1][~late], offsets[-1])
                out.append(_judge(seen, words_between(data, bounds, SPACES), c["start"][~late], {k: v[~late] for k, v in c.items()}, width))
            merged = [np.concatenate([o[i] for o in out]) for i in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(m) for m in merged], names=["doc_id", "row", "start", "end"])


def _judge(seen: Seen, words: Words, start: np.ndarray, columns: dict[str, np.ndarray], width: int) -> tuple[np.ndarray, ...]:
    windows = window_hashes(word_hashes(words), width)
    of = np.searchsorted(words.first, np.arange(len(windows)), side="right") - 1
    at = np.flatnonzero(np.arange(len(windows)) + width <= words.first[of + 1])
    windows, of = windows[at], of[at]
    bucket, doc = columns["bucket"][of], columns["doc_id"][of]
    held = seen.hashes if len(bucket) and seen.bucket == bucket[0] else seen.hashes[:0]
    held_docs = seen.docs[: len(held)]
    all_hash = np.concatenate([held, windows])
    all_bucket = np.concatenate([np.full(len(held), bucket[0] if len(bucket) else 0, dtype=np.int64), bucket])
    all_doc = np.concatenate([held_docs, doc])
    order = np.lexsort((all_doc, all_hash, all_bucket))
    h, b, d = all_hash[order], all_bucket[order], all_doc[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (b[1:] != b[:-1])
    lead = np.flatnonzero(new)
    owner = np.empty(len(order), dtype=np.int64)
    owner[order] = np.repeat(d[lead], np.diff(np.append(lead, len(order))))
    if len(bucket):
        seen.bucket = int(bucket[-1])
        stay = lead[b[lead] == seen.bucket]
        seen.hashes, seen.docs = h[stay].copy(), d[stay].copy()
    marked = np.flatnonzero(owner[len(held) :] < doc)
    # windows of one stretch that follow each other become one run
    place = at[marked]
    begins = np.ones(len(marked), dtype=bool)
    begins[1:] = (np.diff(place) != 1) | (of[marked][1:] != of[marked][:-1])
    first = np.flatnonzero(begins)
    # none where no window is marked
    last = np.append(first, len(marked))[1:] - 1
    r = of[marked[first]]
    offset = start[r] - words.first[r]
    return columns["doc_id"][r], columns["row"][r], place[first] + offset, place[last] + offset + width


def repeated_runs(docs: DataFrame, *, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, row, start, end): runs of words that a document with a smaller id has too; row is the hash of the text.

    `docs` has doc_id (long), text and row.
    """
    targets = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent = docs.filter("doc_id is not null and text is not null").mapInArrow(lambda it: send(it, width, seed, targets), _BLOBS)
    dealt = sent.repartitionById(targets, F.col("target")).mapInArrow(unpack, _ROWS).sortWithinPartitions("bucket", "doc_id")
    return dealt.mapInArrow(lambda it: judge(it, width), _MARKS)


def dedup_substrings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id, text, n_words, removed (runs of words, end exclusive) and kept_text (the words left, by one space)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("row", F.xxhash64("text"))
    runs = repeated_runs(rows, width=width, seed=seed).groupBy("doc_id", "row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("runs"))
    met = rows.join(runs, ["doc_id", "row"], "left").select("doc_id", "text", "runs")
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, "text"):
            words = split_words(texts, SPACES)
            raw, first = words.data.tobytes(), words.first.tolist()
            counts, removed, kept = [], [], []
            for d, found in enumerate(part.column("runs").to_pylist()):
                a, b = first[d], first[d + 1]
                stay = np.ones(b - a, dtype=bool)
                for run in found or ():
                    stay[run["start"] : run["end"]] = False
                at = np.flatnonzero(stay) + a
                kept.append(b" ".join([raw[s:e] for s, e in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)]))
                edge = np.flatnonzero(np.diff(np.concatenate([[1], stay.astype(np.int8), [1]]))).tolist()
                removed.append([{"start": s, "end": e} for s, e in zip(edge[0::2], edge[1::2], strict=True)])
                counts.append(b - a)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text"), pa.array(counts, pa.int64()), pa.array(removed, pair), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "text", "n_words", "removed", "kept_text"],
            )

    return met.mapInArrow(cut, "doc_id long, text string, n_words long, removed array<struct<start: long, end: long>>, kept_text string")


def digest(found: DataFrame) -> DataFrame:
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    return found.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))

