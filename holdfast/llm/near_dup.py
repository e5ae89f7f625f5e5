"""MinHash near-dedup by an inverted join on signature coordinates.

1. Every text gives its set of word shingles (64-bit hashes), a 128-bit key of the set, a signature of COORDINATES minima and
   an odd sketch (one bit per residue: whether an odd number of shingles falls there).  Equal sets are one node; copies only
   add members to it.
2. Nodes are posted under (place, value, class of set size) for POSTED places.  A place holds two coordinates where the
   threshold lets a linked pair agree in enough of such places, so that sets which share a frequent shingle do not meet by it
   alone; for lower thresholds it holds one.  Sets whose sizes allow the similarity are in the same class or in neighbours, so a node is posted in its own class and, as a guest, in the next; a list
   of guests only is left out, as they meet in their own class.  A linked pair
   shares so many places, but for a chance of MISS, that by the prefix rule it meets under one of the rarest places of either
   node; the rest, the long lists, are skipped.
3. Pairs that meet are kept if enough of all coordinates collide (again but for MISS), the sizes allow the similarity, and the
   sketches differ in no more bits than sets as similar can.  Kept pairs are confirmed on the full sets, from the texts.
4. A group of copies must not become all its pairs.  In the first rounds each list offers, for each component in it, one pair
   with the list's first node in the round's own order, and each component confirms the OFFERS pairs that most lists offer.
   Lists that still hold several components are then compared whole, in blocks, but each component offers only the pair whose
   sketches differ least, in round after round while links are found.  When none is, what is left are pairs whose sketches
   allow a link that the texts deny, and a last round confirms every one of them.  A pair inside one component can't change
   the result, so none that matters is left out.

Components are contracted round by round with tables in the shared folder; nothing but counts reaches the driver.

Defined cases: a text with fewer words than a shingle is one shingle of them all; null, empty and blank texts have an empty
set and are linked with nothing (component_id is the row's own doc_id); rows with equal text share a component, also if they
repeat a doc_id, and then all rows with the smallest doc_id are kept; a null doc_id is ignored when the smallest is taken,
and a group without any id is kept (component_id null); columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import binary_parts, fresh, steps, written
from .words import SPACES, mix, split_words, word_hashes

COORDINATES = 64
#: Places that a node is posted under; a place holds two coordinates at most.
POSTED = 24
#: Chance that a pair exactly at the threshold is missed by one of the two counts of collisions; far less above it.
MISS = 2e-7
STAR_ROUNDS = 2
#: Pairs that a component offers in a star round.
OFFERS = 3
#: Members of a pivot that one group of the confirming step holds.
MEMBERS = 256
#: Nodes of one block of a posting list; two blocks meet in a group, and a list of no more is one group.
BLOCK = 1024
SKETCH_BITS = 1024
#: Pairs that a task gathers before it keeps the nearest of each label only, or passes them on.
GATHERED = 1 << 17
#: Rows of pairs or of node numbers, some 50 bytes each, that are sent to all tasks; more are joined by a shuffle.
SENT = 200_000
#: Rounds in which each component offers its nearest pair only, before all are confirmed.
NEAREST_ROUNDS = 8

PAIRS = "a long, la long, b long, lb long"

_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_MASKS = mix(np.arange(1, 65, dtype=np.uint64)) >> np.uint64(1)
#: A sketch has a byte per coordinate, then the bits.
_SKETCH = COORDINATES + SKETCH_BITS // 8


def width_of(percent: int) -> int:
    """Coordinates of a place: two, if a pair at the threshold still agrees in one place but for a chance of MISS."""
    return 2 if least_shared(POSTED, percent**2 / 100) else 1


def places(least: np.ndarray, width: int) -> np.ndarray:
    """The value of each of POSTED places, from `width` coordinates each."""
    held = least[: POSTED * width].reshape(POSTED, width).astype(np.uint64)
    out = held[:, 0]
    for k in range(1, width):
        out = mix((out << np.uint64(32)) | held[:, k]) >> np.uint64(32)
    return out.astype(np.uint32)


def least_shared(coordinates: int, percent: float, miss: float = MISS) -> int:
    """The largest count that a pair at the threshold stays below with a chance of at most `miss`."""
    p, below = percent / 100, 0.0
    for t in range(coordinates + 1):
        below += math.comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below > miss:
            return t
    return coordinates


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    words = split_words(texts, SPACES, lower=True)
    hashes, first = word_hashes(words), words.first.tolist()
    runs = {n: _runs(hashes, n) for n in range(1, size + 1)}
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = min(size, b - a)
        out.append(np.unique(runs[n][a : b - n + 1]) if n else np.empty(0, dtype=np.uint64))
    return out


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    m = len(hashes) - n + 1
    out = np.full(m, n, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[k : k + m]
    return mix(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the least hash under each seed; long sets in slices."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 1 << 14):
        part = shingles[i : i + (1 << 14), None] * _SEEDS
        np.minimum(least, (part ^ (part >> np.uint64(29))).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def sketch(shingles: np.ndarray, least: np.ndarray) -> bytes:
    odd = np.bincount((shingles % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return least.astype(np.uint8).tobytes() + np.packbits(odd.astype(np.uint8)).tobytes()


def most_apart(both: np.ndarray, percent: int) -> np.ndarray:
    """Bits in which the sketches of a pair at the threshold can differ; `both` is the sum of the set sizes.

    At most as many as shingles that only one has; where many of these fall together, seven deviations above the mean.
    """
    apart = np.floor(both * (100 - percent) / (100 + percent))
    share = (1 - (1 - 2 / SKETCH_BITS) ** apart) / 2
    return np.minimum(apart, SKETCH_BITS * share + 7 * np.sqrt(SKETCH_BITS * share * (1 - share)))


def alike(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int, matched: int) -> tuple[np.ndarray, np.ndarray]:
    """(may be linked, bits that differ) of pairs of sketches, row by row."""
    same = (a[..., :COORDINATES] == b[..., :COORDINATES]).sum(axis=-1)
    apart = np.bitwise_count(a[..., COORDINATES:].view(np.uint64) ^ b[..., COORDINATES:].view(np.uint64)).sum(axis=-1, dtype=np.int64)
    sizes = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return sizes & (same >= matched) & (apart <= most_apart(n_a + n_b, percent)), apart


def sketches(column: pa.Array) -> np.ndarray:
    data, _ = binary_parts(column)
    return data.reshape(-1, _SKETCH)


def set_key(shingles: np.ndarray) -> bytes:
    mixed = mix(shingles + np.uint64(0x632BE59BD9B4E019))
    return np.array([shingles.sum(dtype=np.uint64), mixed.sum(dtype=np.uint64)], dtype=np.uint64).tobytes()[::-1]


def signatures(docs: DataFrame, doc_id: str, text: str, size: int, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, "text"):
            sets = shingle_sets(texts, size)
            least = [signature(s) for s in sets]
            flat = pa.array(np.concatenate([places(x, width) for x in least]).view(np.int32))
            offsets = pa.array(np.arange(0, len(flat) + 1, POSTED, dtype=np.int32))
            columns = [
                part.column("doc_id"), part.column("row"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()), pa.ListArray.from_arrays(offsets, flat),
                pa.array([sketch(s, x) for s, x in zip(sets, least, strict=True)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n_shingles", "key", "lead", "sketch"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.withColumn("row", F.xxhash64("text")).mapInArrow(run, "doc_id long, row long, n_shingles long, key binary, lead array<int>, sketch binary")


def postings(nodes: DataFrame, percent: int) -> DataFrame:
    """(list, node) under the rarest places of each node and size class, of those that two nodes at least share, one of them in
    its own class.  Any order of the places will do for the prefix rule, so lists of guests only may come first."""
    ratio = math.log(max(1.01, 100 / percent)) * 1.000001
    classes = F.array(*[F.struct((F.floor(F.log("n") / ratio) + i).alias("view"), F.lit(i == 0).alias("own")) for i in (0, 1)])
    views = nodes.select("node", "lead", F.explode(classes).alias("of")).select("node", "lead", "of.view", "of.own")
    posted = views.select("node", "view", "own", F.posexplode("lead").alias("c", "v")).select("node", "view", "own", F.xxhash64("view", "c", "v").alias("list"))
    counts = posted.groupBy("list").agg(F.count("*").alias("n"), F.max("own").alias("own")).filter("n > 1 and own").drop("own")
    ranked = posted.drop("own").join(counts, "list").groupBy("node", "view").agg(F.sort_array(F.collect_list(F.struct("n", "list"))).alias("shared"))
    # places that no other node has, or guests only, come first in the order and fill their part of the prefix
    room = F.lit(POSTED - least_shared(POSTED, 100 * (percent / 100) ** width_of(percent)) + 1) - (F.lit(POSTED) - F.size("shared"))
    return ranked.filter(room > 0).select("node", F.explode(F.slice("shared", F.lit(1), room)).alias("p")).select("p.list", "node")


def sent(rows: DataFrame, n: int) -> DataFrame:
    """`rows`, about `n` of them, for a join with a large table: large tables stay where they are if the rows are few."""
    return F.broadcast(rows) if n <= SENT else rows


def near(pairs: DataFrame, facts: DataFrame, percent: int, matched: int) -> DataFrame:
    """Of the written table (a, la, b, lb): those whose sketches allow a link."""
    side = lambda x: facts.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
                keep, _ = alike(sketches(batch.column("sketch_a")), sketches(batch.column("sketch_b")), n_a, n_b, percent, matched)
                yield batch.filter(pa.array(keep)).select(["a", "la", "b", "lb"])

    n = pairs.count()
    if n <= SENT:
        met = side("a").join(sent(pairs, n), "a").join(side("b").join(sent(pairs.select("a", "b"), n), "b"), ["a", "b"])
    else:
        met = pairs.join(side("a"), "a").join(side("b"), "b")
    met = met.select("a", "la", "b", "lb", "n_a", "n_b", "sketch_a", "sketch_b")
    return met.mapInArrow(run, PAIRS)


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the written table (a, b): those whose full sets have 100 * intersection >= percent * union.

    The texts of all partners of a meet a's own; beyond MEMBERS partners in several groups, each with a copy of a's text.
    """
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("groups"))
    members = pairs.join(groups, "a").select(F.col("b").alias("node"), "a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("salt"))
    heads = groups.select(F.col("a").alias("node"), "a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"))
    # one join for both, so that texts move once
    rows = texts.join(sent(members.unionByName(heads), 2 * pairs.count()), "node").select("a", "salt", "b", "text")
    dealt = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, None
        for part, data in steps(batches, "text"):
            a, b, salt = (part.column(c).to_pylist() for c in ("a", "b", "salt"))
            found = []
            for x, y, z, s in zip(a, b, salt, shingle_sets(data, size), strict=True):
                if y is None:
                    head, own = (x, z), s
                elif head == (x, z):
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        found.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def in_blocks(rest: DataFrame) -> DataFrame:
    """(list, i, j, own, node, label, n, sketch): every pair of different labels of a list is in the group of one (i, j), with
    `own` its blocks; two of the same block are a pair where i = j only.

    A list of more than two blocks is cut into blocks of about BLOCK nodes, those of its most frequent label apart from the
    others.  Blocks meet in pairs, but for two of that label: what most members have joined already is sent as often as the
    others have blocks, not as often as itself.
    """
    small = F.col("members") <= 2 * BLOCK
    apart = ~small & (F.col("label") == F.col("most"))
    few = F.when(small, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("others") / BLOCK))).cast("int")
    many = F.when(small, 0).otherwise(F.ceil((F.col("members") - F.col("others")) / BLOCK)).cast("int")
    block = F.when(apart, few + F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), many))).otherwise(F.pmod(F.xxhash64("node"), few)).cast("int")
    meets = F.when(apart, few).otherwise(few + many)
    own = rest.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), meets - 1)))
    return own.select("list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "n", "sketch")


def pairs_within(rest: DataFrame, percent: int, matched: int, every: bool) -> DataFrame:
    """(list, a, la, b, lb): pairs of a list with different labels whose sketches allow a link: every one, or for each label the
    one that differs least.

    `rest` has list, members (of the list), most (its most frequent label), others (members of other labels), node, label, n
    and sketch.  Each pair of blocks meets in a group of its own and is compared there with arrays.
    """
    rows = in_blocks(rest)
    order = ("list", "i", "j")
    dealt = rows.repartition(*order).sortWithinPartitions(*order)

    def compare(t: pa.Table, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of whole groups: each is compared with the one d rows on, for every d that stays inside a group."""
        n, marks, own = t.column("n").to_numpy(), sketches(t.column("sketch").combine_chunks()), t.column("own").to_numpy()
        lists, label, node = (t.column(c).to_numpy() for c in ("list", "label", "node"))
        single = t.column("i").to_numpy() == t.column("j").to_numpy()
        # columns: both rows, the one of the smaller label first, and the bits that differ
        held = np.empty((3, 0), dtype=np.int64)

        def nearest(found: np.ndarray) -> np.ndarray:
            a, b, apart = found
            best = []
            for own in (a, b):
                ordered = np.lexsort((node[b], node[a], apart, label[own], keys[a]))
                group, of = keys[a][ordered], label[own][ordered]
                best.append(ordered[np.append(True, (group[1:] != group[:-1]) | (of[1:] != of[:-1]))])
            return found[:, np.unique(np.concatenate(best))]

        def batch(found: np.ndarray) -> pa.RecordBatch:
            columns = [lists[found[0]], *(x[at] for at in found[:2] for x in (node, label))]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["list", "a", "la", "b", "lb"])

        here, d = np.arange(len(n) - 1), 1
        while len(here):
            here = here[here + d < len(n)]
            here = here[keys[here + d] == keys[here]]
            x = here[(label[here] != label[here + d]) & (single[here] | (own[here] != own[here + d]))]
            if len(x):
                keep, apart = alike(marks[x], marks[x + d], n[x], n[x + d], percent, matched)
                x, apart = x[keep], apart[keep]
                first = label[x] < label[x + d]
                held = np.concatenate([held, np.stack([np.where(first, x, x + d), np.where(first, x + d, x), apart])], axis=1)
                if held.shape[1] > GATHERED and every:
                    yield batch(held)
                    held = held[:, :0]
                elif held.shape[1] > GATHERED:
                    held = nearest(held)
            d += 1
        yield batch(held if every or not held.shape[1] else nearest(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts)
            keys = np.stack([t.column(c).to_numpy() for c in order])
            return compare(t, np.append(0, np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))))

        for batch in batches:
            if not batch.num_rows:
                continue
            # the last group may go on in the next batch
            differs = np.any([batch.column(c).to_numpy() != batch.column(c)[batch.num_rows - 1].as_py() for c in order], axis=0)
            before = np.flatnonzero(differs)
            if len(before):
                held.append(batch.slice(0, before[-1] + 1))
                yield from found(held)
                held = [batch.slice(before[-1] + 1)]
            else:
                if held and any(held[-1].column(c)[0].as_py() != batch.column(c)[0].as_py() for c in order):
                    yield from found(held)
                    held = []
                held.append(batch)
        if held:
            yield from found(held)

    return dealt.mapInArrow(run, "list long, " + PAIRS)


def components(edges: DataFrame, name: str = "component") -> DataFrame:
    """(node, label) for every node with an edge; label is a node of its component.

    Every node points to its least neighbour, edges move to what their ends point to, and so on until none is left.  Keys are
    hashes, so the number of edges falls by a factor in each round.
    """
    labels = None
    edges = written(edges.select("a", "b").filter("a != b").distinct(), name)
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), name)
        if labels is None:
            labels = step.withColumnRenamed("to", "label")
        else:
            moved = labels.join(step.withColumnRenamed("node", "label"), "label", "left")
            labels = moved.select("node", F.coalesce("to", "label").alias("label"))
        labels = written(labels, name)
        a, b = step.select(F.col("node").alias("a"), F.col("to").alias("x")), step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(a, "a").join(b, "b").filter("x != y")
        edges = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), name)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


def relabel(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """Labels after the components `merged` (node, label) of labels."""
    to = merged.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))


def numbered_nodes(rows: DataFrame, *facts: Column) -> DataFrame:
    """A row per different set of `rows` (key, doc_id, row): key, node (its number), rep (the document that stands for it),
    doc_id (the least) and `facts`.  Numbers are written once and read from there."""
    one = [F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("rep"), F.min("doc_id").alias("doc_id")]
    return written(rows.filter("key is not null").groupBy("key").agg(*one, *facts).withColumn("node", F.monotonically_increasing_id()), "nodes")


def settle(posted: DataFrame, nodes: DataFrame, docs: DataFrame, *, doc_id: str, text: str, size: int, percent: int, matched: int) -> DataFrame:
    """(node, label) of the nodes on any list: components of the links between nodes that share a list.

    `posted` has list and node, each pair once; `nodes` has node, rep, n and sketch; `matched` is the number of coordinates
    that a link must share at least.
    """
    on_lists = posted.select("node").distinct()
    known = written(nodes.join(on_lists, "node").select("node", "n", "sketch", "rep"), "facts")
    facts = known.select("node", "n", "sketch")
    texts = written(texts_of(sent(known.select("node", "rep.doc_id", "rep.row"), known.count()), docs, doc_id, text), "texts")
    labels = known.select("node", F.col("node").alias("label"))
    opened = posted.withColumn("label", F.col("node"))
    # lists that offered a pair when all were compared last; the others are done
    offering: DataFrame | None = None

    def going_on(lists: DataFrame) -> DataFrame:
        """Of a table with a row per list, those that are not done: rows of `opened` meet what is left of it only."""
        return lists if offering is None else lists.join(offering, "list", "left_semi")

    def merge(pairs: DataFrame) -> bool:
        """Confirm (a, la, b, lb), join the components that links connect, and keep the lists that hold several still."""
        nonlocal labels, opened
        found = confirm(pairs.select("a", "b"), texts, size, percent).join(pairs, ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b"))
        found = written(found, "links")
        if found.isEmpty():
            return False
        merged = components(found)
        labels = written(relabel(labels, merged), "labels")
        to = merged.select(F.col("node").alias("label"), F.col("label").alias("to"))
        moved = opened.join(to, "label", "left").select("list", "node", F.coalesce("to", "label").alias("label"))
        opened = written(open_rows(moved), "open")
        return True

    def open_rows(rows: DataFrame) -> DataFrame:
        several = rows.groupBy("list").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi")
        return rows.join(going_on(several).select("list"), "list")

    for number in range(STAR_ROUNDS):
        # the list's first node is the least number under a mask of the round
        mask = F.lit(int(_MASKS[number]))
        heads = opened.groupBy("list", "label").agg(F.min(F.col("node").bitwiseXOR(mask)).alias("p"))
        pivots = heads.groupBy("list").agg(F.min("p").alias("first"))
        met = heads.join(pivots, "list").filter("p != first")
        a, b = F.col("first").bitwiseXOR(mask), F.col("p").bitwiseXOR(mask)
        # a pair that meets once only is most often none; the last steps look at those
        offered = met.groupBy(a.alias("a"), b.alias("b"), F.col("label").alias("lb")).agg(F.count("*").alias("n")).filter("n > 1")
        turn = F.row_number().over(Window.partitionBy("lb").orderBy(F.col("n").desc(), "a", "b"))
        best = offered.withColumn("turn", turn).filter(F.col("turn") <= OFFERS).drop("turn", "n")
        best = best.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").select("a", "la", "b", "lb")
        if not merge(written(near(written(best, "offers"), facts, percent, matched), "stars")):
            break

    def whole(every: bool) -> DataFrame:
        nonlocal offering
        sizes = opened.groupBy("list", "label").agg(F.count("*").alias("n")).groupBy("list").agg(F.sum("n").alias("members"), F.max(F.struct("n", "label")).alias("top"))
        sizes = going_on(sizes.select("list", "members", F.col("top.label").alias("most"), (F.col("members") - F.col("top.n")).alias("others")))
        rest = opened.join(sizes, "list").join(facts, "node")
        pairs = written(pairs_within(rest, percent, matched, every), "rest")
        offering = pairs.select("list").distinct()
        return written(pairs.drop("list").distinct(), "pairs")

    opened = written(open_rows(opened), "open")
    for _ in range(NEAREST_ROUNDS):
        pairs = whole(False)
        if pairs.isEmpty():
            return labels
        if not merge(pairs):
            break
    merge(whole(True))
    return labels


def link(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """A row per document: doc_id, row (hash of the text), group (key of the component, null for an empty set), n_shingles,
    component_id, kept."""
    rows = written(signatures(docs, doc_id, text, size, width_of(percent)), "signatures")
    nodes = numbered_nodes(rows, F.first("n_shingles").alias("n"), F.first("lead").alias("lead"), F.first("sketch").alias("sketch"))
    posted = written(postings(nodes, percent), "postings")
    labels = settle(posted, nodes, docs, doc_id=doc_id, text=text, size=size, percent=percent, matched=least_shared(COORDINATES, percent))
    return grouped(rows, nodes, labels)


def grouped(rows: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, row, group, n_shingles, component_id, kept of `rows` from the labels of nodes that have one."""
    known = nodes.select("node", "doc_id").join(labels, "node")
    least = known.groupBy("label").agg(F.min("doc_id").alias("least"))
    linked = known.join(least, "label").select("node", "label", "least")
    every = nodes.select("key", "node", "doc_id").join(linked, "node", "left")
    every = every.select("key", F.coalesce("label", "node").alias("group"), F.coalesce("least", "doc_id").alias("component_id"))
    out = rows.select("doc_id", "row", "n_shingles", "key").join(every, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "row", "group", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def texts_of(needed: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, text) of the document that stands for each node; rows that repeat it give the same pair again."""
    source = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("text")).withColumn("r", F.xxhash64("text"))
    return source.join(needed, source["d"].eqNullSafe(needed["doc_id"]) & (source["r"] == needed["row"])).select("node", "text")


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay: of each component one, with the smallest doc_id (and of rows that repeat it, one).

    Rows without words stay once for each id and text; components without any id keep one text.
    """
    judged = link(docs, doc_id=doc_id, text=text, size=size, percent=percent).filter("kept")
    alone = F.when(F.col("group").isNull(), F.struct("doc_id", "row"))
    one = judged.groupBy("group", alone.alias("alone")).agg(F.min(F.struct("doc_id", "row")).alias("r"))
    spelled = lambda i, r: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), r.cast("string"))
    key = fresh(docs, "row_key")
    stay = one.select(spelled(F.col("r.doc_id"), F.col("r.row")).alias(key)).distinct()
    keyed = docs.withColumn(key, spelled(F.col(doc_id).cast("long"), F.xxhash64(F.col(text).cast("string"))))
    return keyed.join(stay, key).dropDuplicates([key]).drop(key)
