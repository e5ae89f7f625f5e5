"""N-gram Jaccard join by PartEnum signatures.

Texts become sets of word shingles, equal sets one node.  Sets of similar size meet in a view, the size band of the larger
one: a set has the view of its own band, and the next one too if a partner may be there.

1. In a view, two sets with the similarity differ in D features at most, D from the sizes.  The feature domain is dealt by hash
   into groups of parts.  For bands of small sets a group has three parts, and each subset of two parts gives a signature: it
   survives every difference in the part left out.  For larger sets a group is one part, and its whole is the signature.
2. D differences leave so many signatures alike (`alike_at_least`), so two similar sets share one, and even when each set
   leaves out that many less one by an order both agree on.  The order puts signatures of few features last: those, the empty
   ones first, are what unrelated sets have in common.
3. Signatures are sorted by value as a stream, and only those of two sets at least go on.  Sets that share one are compared as
   near_dup.settle does: components offer pairs, which the full sets confirm.

Held at once: the signatures of the texts of one step, and the pairs of a block of a list; a signature that very many sets
have is a sorted stream, then a list that is compared in blocks.

Defined cases: as in near_dup: a text with fewer words than a shingle is one shingle of them all; null, empty and blank texts
have an empty set and are linked with nothing; rows with equal text share a component, also if they repeat a doc_id; a null
doc_id is ignored when the smallest is taken; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_dup
from .common import steps, written
from .words import mix

#: A band ends at this multiple of the band before; at least the inverse of the similarity, so that partners are in neighbours.
BAND = 1.5
#: Bands up to this size enumerate two of three parts.
SMALL = 96
#: Signatures that similar sets share beyond the first, as a share of the differences and at least.
SPARE, LEAST_SPARE = 0.15, 3
#: Sets that a task remembers to send equal ones once.
REMEMBERED = 1 << 18


class Views(NamedTuple):
    """By band: its largest size, the number of groups, and the parts of a group (a group of several leaves one out)."""

    ends: np.ndarray
    groups: np.ndarray
    parts: np.ndarray


def most_different(one: np.ndarray, two: np.ndarray, percent: int) -> np.ndarray:
    """Features in which sets of these sizes can differ at most when 100 * intersection >= percent * union."""
    return (one + two) * (100 - percent) // (100 + percent)


def views_of(percent: int, largest: int, band: float = BAND) -> Views:
    band = max(band, 100 / percent)
    ends = [1]
    while ends[-1] < largest:
        ends.append(max(ends[-1] + 1, int(ends[-1] * band)))
    # partners of a band's sets must not be beyond the next band
    ends = np.array(ends, dtype=np.int64)
    different = most_different(ends, ends, percent)
    spare = np.maximum(LEAST_SPARE, np.ceil(SPARE * different).astype(np.int64))
    small = ends <= SMALL
    return Views(ends, np.where(small, (different + 1) // 2 + spare, different + spare), np.where(small, 3, 1))


def alike_at_least(groups: np.ndarray, parts: np.ndarray, different: np.ndarray) -> np.ndarray:
    """Signatures that two sets share at least.

    A first difference in a group of p parts spoils p - 1 of its p signatures (all of one), a second one in another part the
    last; spread over as many groups as possible, differences spoil most.
    """
    first = np.minimum(different, groups)
    second = np.minimum(different - first, groups)
    return np.where(parts > 1, parts * groups - (parts - 1) * first - second, np.maximum(groups - different, 0))


def _items(n: np.ndarray, views: Views, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, view) of every view a set has."""
    own = np.searchsorted(views.ends, n)
    more = (n * 100 // percent > views.ends[np.minimum(own, len(views.ends) - 1)]) & (own + 1 < len(views.ends))
    every = np.concatenate([np.arange(len(n)), np.flatnonzero(more)])
    return every, np.concatenate([own, own[more] + 1])


def signatures(sets: list[np.ndarray], views: Views, percent: int) -> list[np.ndarray]:
    """The signatures each set is posted under, for all its views."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    out: list[list[np.ndarray]] = [[] for _ in sets]
    which, view = _items(n, views, percent)
    have = n[which] > 0
    which, view = which[have], view[have]
    if not len(which):
        return [np.empty(0, dtype=np.uint64) for _ in sets]
    groups, parts = views.groups[view], views.parts[view]
    cells = groups * parts
    base = np.append(0, np.cumsum(cells))
    flat = np.concatenate([sets[i] for i in which])
    size = n[which]
    item = np.repeat(np.arange(len(which)), size)
    spread = mix(flat ^ np.uint64(0x5851F42D4C957F2D))
    cell = base[:-1][item] + (spread % cells[item].astype(np.uint64)).astype(np.int64)
    total = np.zeros(base[-1], dtype=np.uint64)
    np.add.at(total, cell, mix(flat + np.uint64(0x14057B7EF767814F)))
    count = np.bincount(cell, minlength=base[-1])
    # the signature of a cell: its own features, or those of the other cells of its group
    cell_item = np.repeat(np.arange(len(which)), cells)
    place = np.arange(base[-1]) - base[:-1][cell_item]
    three = parts[cell_item] > 1
    if three.any():
        some = np.flatnonzero(three)
        rows = some.reshape(-1, 3)
        total[some] = (total[rows].sum(axis=1, dtype=np.uint64)[:, None] - total[rows]).reshape(-1)
        count[some] = (count[rows].sum(axis=1)[:, None] - count[rows]).reshape(-1)
    value = mix(mix(total + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + view[cell_item].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    partner = np.minimum(size * 100 // percent, views.ends[view])
    keep = cells - np.maximum(alike_at_least(groups, parts, most_different(size, np.maximum(partner, size), percent)), 1) + 1
    order = np.lexsort((value, -count, cell_item))
    ordered = value[order]
    for i, w in enumerate(which.tolist()):
        out[w].append(ordered[base[i] : base[i] + keep[i]])
    return [np.concatenate(x) if x else np.empty(0, dtype=np.uint64) for x in out]


def scan(docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """doc_id, row (hash of the text), n_shingles, key (of the set), sketch, lists; equal sets have lists once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, None] = {}
        views = views_of(percent, 1)
        for part, texts in steps(batches, "text"):
            sets = near_dup.shingle_sets(texts, size)
            longest = max(map(len, sets), default=0) * 100 // percent + 1
            if views.ends[-2:].min() < longest:
                views = views_of(percent, 2 * longest)
            keys = [near_dup.set_key(s) if len(s) else None for s in sets]
            fresh = []
            for i, key in enumerate(keys):
                if key is not None and key not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[key] = None
                    fresh.append(i)
            found = dict(zip(fresh, signatures([sets[i] for i in fresh], views, percent), strict=True))
            none = np.empty(0, dtype=np.uint64)
            lists = [found.get(i, none) for i in range(len(sets))]
            marks: list[bytes | None] = [None] * len(sets)
            for i in fresh:
                marks[i] = near_dup.sketch(sets[i], near_dup.signature(sets[i]))
            offsets = pa.array(np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32))
            columns = [
                part.column("doc_id"), part.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.binary()),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lists).view(np.int64) if lists else np.empty(0, dtype=np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n_shingles", "key", "sketch", "lists"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.withColumn("row", F.xxhash64("text")).mapInArrow(run, "doc_id long, row long, n_shingles long, key binary, sketch binary, lists array<long>")


def shared(posted: DataFrame) -> DataFrame:
    """The distinct rows (list, alias) of lists with two different aliases at least: one pass over rows sorted by both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["list", "alias"]
        # the last row so far, and whether it has gone out
        held: tuple[int, int] | None = None
        out = False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy() for c in names])
            rows = rows[:, np.append(True, (rows[:, 1:] != rows[:, :-1]).any(axis=0))]
            again = held is not None and held == (int(rows[0, 0]), int(rows[1, 0]))
            if held is not None and not again:
                rows = np.concatenate([np.array(held, dtype=np.int64)[:, None], rows], axis=1)
            same = rows[0, 1:] == rows[0, :-1]
            keep = np.append(False, same) | np.append(same, False)
            done = out and held is not None
            if done:
                keep[0] = False
            if keep.any():
                chosen = rows[:, keep]
                yield pa.RecordBatch.from_arrays([pa.array(chosen[0]), pa.array(chosen[1])], names=names)
            last = rows.shape[1] - 1
            out = bool(keep[last]) or (last == 0 and done)
            held = (int(rows[0, last]), int(rows[1, last]))

    dealt = posted.repartition("list").sortWithinPartitions("list", "alias")
    return dealt.mapInArrow(run, "list long, alias long")


def join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, row, group, n_shingles, component_id, kept, as near_dup.link gives them."""
    rows = written(scan(docs, doc_id, text, size, percent), "sets")
    alias = F.xxhash64("key")
    nodes = near_dup.numbered_nodes(rows, F.first("n_shingles").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch"))
    met = written(shared(rows.filter("key is not null").select(F.explode("lists").alias("list"), alias.alias("alias"))), "shared")
    posted = written(met.join(nodes.select(alias.alias("alias"), "node"), "alias").select("list", "node"), "postings")
    matched = near_dup.least_shared(near_dup.COORDINATES, percent)
    labels = near_dup.settle(posted, nodes, docs, doc_id=doc_id, text=text, size=size, percent=percent, matched=matched)
    return near_dup.grouped(rows, nodes, labels)
