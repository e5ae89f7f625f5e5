"""Prefix trie of conversations by bursting containers.

A turn is (role, text) and travels as 128 bits of its SHA-256 and the length of its text, so a conversation is a byte string
of ids.  Equal conversations are one row with their number and least id.

1. All rows start in the container of the root.  A container is (head: the trie node it hangs on, suffixes below it).  One
   with more than CONTAINER rows or TURNS turns is burst: its first and last row in order of bytes give the turns that all its
   rows share, which become a chain of trie heads at once, and the rows go to new containers by their next turn.  So a round
   goes down to the next branching, however long the shared beginning; sums of containers are made in each task first.
2. The containers that remain are dealt out by head and sorted by suffix; a sweep keeps the path of the last row open, closes
   the nodes that the next row leaves, and hands their members, leaves and savings to their parents.
3. Heads get their sums from the containers below them, the last burst first.

Held at once: the nodes of one container, bounded by CONTAINER and TURNS (one conversation, if longer), and one conversation
in a row.  The list of ids that end at a node is hashed as a sorted stream.

Defined cases: null role and text are empty; turns are ordered by turn, null first, ties by the hash of the turn, and rows that
repeat are turns of their own; rows without a conv_id are ignored; an empty table has no nodes; columns other than the four
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Distinct conversations, and turns below the head, that a container holds at most.
CONTAINER = 4096
TURNS = 1 << 20
ID = 16
EMPTY = hashlib.sha256(b"").hexdigest()

_NODES = "up string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def numbered(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 1), id (hex) and size (code points of the text) of every turn."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    key = F.substring(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t).cast("binary"), 256), 1, 2 * ID)
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), key.alias("id"), F.length(t).cast("long").alias("size")).filter("conv_id is not null")
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "id"))
    return rows.select("conv_id", pos.alias("pos"), "id", "size")


def sequences(parts: DataFrame) -> DataFrame:
    """conv_id, seq (the ids) and sizes from rows (conv_id, src, pos, id, size) in order of src and pos; a null id only names
    a conversation."""
    one = F.when(F.col("id").isNotNull(), F.struct("src", "pos", "id", "size"))
    held = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return held.select("conv_id", F.unhex(F.array_join("turns.id", "")).alias("seq"), F.col("turns.size").alias("sizes"))


def rebuilt(turns: DataFrame, shared: Callable[[Column], Column], every: int = 100) -> DataFrame:
    """Conversations that begin with the first shared(conv_id) turns of conversation conv_id - conv_id % every, then their own
    turns after as many.  `shared` is below `every`, so a beginning is read by that many conversations at most."""
    rows = written(numbered(turns), "turns")
    c = F.col("conv_id")
    own = rows.filter(F.col("pos") > shared(c)).select("conv_id", F.lit(1).alias("src"), "pos", "id", "size")
    convs = rows.filter("pos = 1").select("conv_id", F.lit(0).alias("src"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("long").alias("size"))
    lead = rows.filter(c % every == 0).select(c.alias("base"), "pos", "id", "size")
    to = rows.filter("pos = 1").select("conv_id", (c - c % every).alias("base"), shared(c).alias("shared"))
    begun = to.join(lead, "base").filter("pos <= shared").select("conv_id", F.lit(0).alias("src"), "pos", "id", "size")
    return sequences(own.unionByName(begun).unionByName(convs))


def ends_of(rows: DataFrame) -> DataFrame:
    """(key, ends): the SHA-256 of each key's conversation ids, ascending and comma-joined, as one stream per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, hashlib.sha256()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").dictionary_encode()
            code, ids = keys.indices.to_numpy(), batch.column("conv_id").to_pylist()
            edge = np.flatnonzero(np.append(True, code[1:] != code[:-1])).tolist()
            done: list[tuple[str, str]] = []
            for a, b in zip(edge, [*edge[1:], len(ids)], strict=True):
                name, text = batch.column("key")[a].as_py(), ",".join(map(str, ids[a:b])).encode()
                if name == key:
                    sha.update(b"," + text)
                else:
                    if key is not None:
                        done.append((key, sha.hexdigest()))
                    key, sha = name, hashlib.sha256(text)
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], names=["key", "ends"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sha.hexdigest()])], names=["key", "ends"])

    dealt = rows.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    return dealt.mapInArrow(run, "key string, ends string")


class Sweep:
    """The nodes of one container, from its rows in order of their suffixes."""

    def __init__(self, head: str, depth: int, parent: int | None, up: str | None) -> None:
        self.head, self.top, self.parent, self.up = head, depth, parent, up
        self.seq = b""
        self.open: list[int] = []
        # per node: depth, size of the last text, place of the parent, least id, members, children, leaves, savings, ends
        self.nodes: list[list] = []

    def add(self, seq: bytes, sizes: list[int], n: int, least: int, ends: str) -> None:
        shared = self.top
        if self.open:
            most = min(len(seq), len(self.seq)) // ID
            while shared < most and seq[ID * shared : ID * shared + ID] == self.seq[ID * shared : ID * shared + ID]:
                shared += 1
            while len(self.open) > shared - self.top + 1:
                self.close()
        for depth in range(self.top + len(self.open), len(sizes) + 1):
            above = self.open[-1] if self.open else -1
            if above >= 0:
                self.nodes[above][5] += 1
            self.open.append(len(self.nodes))
            self.nodes.append([depth, sizes[depth - 1] if depth else 0, above, None, 0, 0, 0, 0, EMPTY])
        last = self.nodes[self.open[-1]]
        last[3], last[4], last[8] = least if last[3] is None else min(last[3], least), last[4] + n, ends
        self.seq = seq

    def close(self) -> None:
        node = self.nodes[self.open.pop()]
        node[6] = node[6] or 1
        node[7] += (node[4] - 1) * node[1]
        if node[2] >= 0:
            above = self.nodes[node[2]]
            above[3] = node[3] if above[3] is None else min(above[3], node[3])
            above[4], above[6], above[7] = above[4] + node[4], above[6] + node[6], above[7] + node[7]

    def rows(self) -> list[tuple]:
        while self.open:
            self.close()
        parents = [self.nodes[x[2]][3] if x[2] >= 0 else self.parent for x in self.nodes]
        return [(self.up if x[2] < 0 else None, x[3], x[0], p, *x[4:]) for x, p in zip(self.nodes, parents, strict=True)]


def node_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _NODES.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in _NODES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (head, seq) -> nodes; the top node of a container has `up`."""
    held: Sweep | None = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("head", "depth", "parent", "up", "seq", "sizes", "n", "least", "ends")]
        for head, depth, parent, up, *row in zip(*columns, strict=True):
            if held is None or held.head != head:
                if held is not None:
                    yield node_batch(held.rows())
                held = Sweep(head, depth, parent, up)
            held.add(*row)
    if held is not None:
        yield node_batch(held.rows())


def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Burst containers with the sums of their children -> the nodes from their head down to where they branch."""
    for batch in batches:
        rows: list[tuple] = []
        for x in batch.to_pylist():
            lowest, n = x["bottom"], x["n"]
            saved, chain = x["saved"], []
            for depth in range(lowest, x["depth"] - 1, -1):
                saved += (n - 1) * (x["sizes"][depth - 1] if depth else 0)
                top, end = depth == x["depth"], depth == lowest
                chain.append((x["up"] if top else None, x["least"], depth, x["parent"] if top else x["least"], n, x["children"] if end else 1, x["leaves"], saved, x["ends"] if end else EMPTY))
            rows += reversed(chain)
        yield node_batch(rows)


def _shared(lo: Column, hi: Column, depth: Column) -> Column:
    """The number of turns that the first and the last row of a container share."""
    most = (F.least(F.length(lo), F.length(hi)) / ID).cast("int")
    same = lambda k: F.substring(lo, k * ID + 1, F.lit(ID)) != F.substring(hi, k * ID + 1, F.lit(ID))
    rest = F.when(most > depth, F.sequence(depth, most - 1)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_min(F.filter(rest, same)), most)


def trie(convs: DataFrame, *, container: int = CONTAINER, turns: int = TURNS) -> DataFrame:
    """The nodes of the trie of `convs` (conv_id, seq, sizes): conv_id (least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (over the subtree, members less one times code points) and ends_sha256."""
    convs = written(convs.withColumn("key", F.sha2("seq", 256)), "conversations")
    distinct = convs.groupBy("key").agg(F.first("seq").alias("seq"), F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    rows = distinct.join(ends_of(convs), "key")
    none = F.lit(None).cast("string")
    held = rows.select(F.lit("").alias("head"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), none.alias("up"), "seq", "sizes", "n", "least", "ends")
    held = written(held, "container")
    full: list[DataFrame] = []
    ready: list[DataFrame] = []
    while True:
        sums = [F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("up").alias("up"), F.sum("n").alias("n"), F.min("least").alias("least")]
        edges = [F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.min_by(F.struct("sizes", "ends"), "seq").alias("first")]
        size = [F.count("*").alias("rows"), F.sum(F.size("sizes") - F.col("depth")).alias("turns")]
        much = held.groupBy("head").agg(*sums, *edges, *size).filter((F.col("rows") > container) | ((F.col("rows") > 1) & (F.col("turns") > turns)))
        much = much.withColumn("bottom", _shared(F.col("lo"), F.col("hi"), F.col("depth")))
        ends = F.when(F.length("lo") == F.col("bottom") * ID, F.col("first.ends")).otherwise(EMPTY)
        burst = written(much.select("head", "depth", "parent", "up", "n", "least", "bottom", F.slice("first.sizes", F.lit(1), F.col("bottom")).alias("sizes"), ends.alias("ends")), "burst")
        if burst.isEmpty():
            ready.append(held)
            break
        full.append(burst)
        ready.append(held.join(burst.select("head"), "head", "left_anti").select(*held.columns))
        to = burst.select("head", F.col("bottom").alias("lowest"), F.col("least").alias("above"))
        below = held.drop("parent", "up", "depth").join(to, "head").filter(F.size("sizes") > F.col("lowest"))
        head = F.sha2(F.substring(F.col("seq"), F.lit(1), (F.col("lowest") + 1) * ID), 256)
        moved = below.select(head.alias("next"), (F.col("lowest") + 1).alias("depth"), F.col("above").alias("parent"), F.col("head").alias("up"), "seq", "sizes", "n", "least", "ends")
        held = written(moved.withColumnRenamed("next", "head").select(*held.columns), "container")
    swept = ready[0]
    for more in ready[1:]:
        swept = swept.unionByName(more)
    dealt = swept.repartition("head").sortWithinPartitions("head", "seq")
    parts = [written(dealt.mapInArrow(sweep, _NODES), "nodes")]
    tops = parts[0].filter("up is not null")
    for burst in reversed(full):
        sums = tops.groupBy(F.col("up").alias("head")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        nodes = written(burst.join(sums, "head").mapInArrow(chains, _NODES), "heads")
        parts.append(nodes)
        tops = tops.unionByName(nodes.filter("up is not null"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.drop("up")


def beginning(conv_id: Column) -> Column:
    """How many turns a rebuilt conversation takes over: 0 to 5, by the CRC-32 of its decimal id."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 6


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of the conversations of `turns` (conv_id, turn, role, text), rebuilt so that they share beginnings."""
    return trie(rebuilt(turns, beginning))
