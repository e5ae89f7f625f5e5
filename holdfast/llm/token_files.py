"""Token ids in files: frequency-ranked, byte-aligned codes with separate control bytes.

Ids are replaced by their rank in frequency over the whole corpus (ties to the smaller id), so frequent ids take one byte.  A
document's ranks are written as two byte strings: the bytes of each rank, least first and without leading zero bytes (one at
least), and control bytes with two bits per rank, its number of bytes less one, four ranks to a byte from the low bits up.
A reader looks each control byte up in a table of four lengths, places the bytes by a running sum, and never branches by value.

The files are Parquet, written by Spark in ascending doc_id order, so they land whole or not at all in whatever store Spark
writes to: `tokens` has a row per document (part, doc_id, n_tokens, checksum of the
ids, control, data), `ranks` a row per used id (rank, id, n).
Bounded by the vocabulary: the counts per task and the rank table, the only thing the driver and every task hold.

Encoding runs the tokenizers library on every distinct pre-token a task meets and joins the ids; a text with any character
for which pre-tokenising outside the library could differ is encoded by the library as a whole.

Defined cases: a null or empty text has the end id only; rows with a null doc_id come first; rows that repeat a doc_id follow
each other by length and checksum; an empty table gives empty files; extra columns are not read.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_path
from .common import binary_column, binary_parts, crc, slices, steps
from .words import PACKED, Words, differing, packed, word_hashes

END = 2
#: Pre-tokens that a worker remembers, some 60 bytes each, and so many that the library encodes at once.
_KNOWN = 1_000_000
_AT_ONCE = 4096

# Classes of characters, for those whose class is the same in every Unicode version and library.  Others, and NUL, are odd.
_LETTER, _DIGIT, _MARK, _SPACE, _BREAK, _ODD = range(6)
_CLASSES = np.full(0x250, _ODD, dtype=np.uint8)
_CLASSES[[0x09, 0x0A, 0x0D, 0x20]] = _SPACE
for _code in (*range(0x21, 0x7F), *range(0xA1, 0x250)):
    _CLASSES[_code] = {"L": _LETTER, "N": _DIGIT}.get(unicodedata.category(chr(_code))[0], _MARK)
_CLASSES[0xAD] = _ODD
#: What may follow an apostrophe as a pre-token with it (fixed by the tokenizer's splitting rule).
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def piece_starts(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, for characters of the plain classes and breaks between texts.

    The rule of the tokenizer file: `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`.
    A run of one class is a pre-token, with a blank before it; of other white space the last character stands alone unless
    the text ends there.
    """
    before, after = np.append(_BREAK, kinds[:-1]), np.append(kinds[1:], _BREAK)
    start = (kinds != before) | (kinds == _BREAK)
    word = kinds < _SPACE
    start |= (kinds == _SPACE) & (after < _SPACE)
    blank = np.append(False, codes[:-1] == 0x20)
    start &= ~(word & blank)
    at = np.flatnonzero((codes == 0x27) & start & (after == _LETTER))
    if len(at):
        padded = np.append(codes, [0, 0, 0])
        for ending in _ENDINGS:
            here = at[np.all([padded[at + 1 + k] == ord(c) for k, c in enumerate(ending)], axis=0)]
            start[here + 1] = False
            then = here + 1 + len(ending)
            then = then[then < len(kinds)]
            start[then[kinds[then] == _LETTER]] = True
    return np.flatnonzero(start)


class Encoder:
    """ids of texts, with a bounded memory of pre-tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        """hashes[k], ascending, is that of pre-token i = numbers[k]; its ids are ids[offsets[i]:offsets[i + 1]], and it is spelled
        by low[i], high[i] and size[i], or by long[i].  Arrays, as a dictionary of as many takes several times the room."""
        self.hashes, self.numbers = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int32)
        self.long: dict[int, bytes] = {}
        self.ids, self.offsets = np.empty(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        self.low, self.high, self.size = (np.empty(0, dtype=kind) for kind in (np.uint64, np.uint64, np.int32))

    def met(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each of the ascending `hashes` stands or would stand, and whether it does."""
        place = np.searchsorted(self.hashes, hashes)
        there = place < len(self.hashes)
        there[there] = self.hashes[place[there]] == hashes[there]
        return place, there

    def learn(self, place: np.ndarray, hashes: np.ndarray, pieces: list[bytes], low: np.ndarray, high: np.ndarray) -> None:
        n, ids, counts = len(self.size), [self.ids], []
        for i in range(0, len(pieces), _AT_ONCE):
            found = self.tokenizer.encode_batch_fast([p.decode() for p in pieces[i : i + _AT_ONCE]], add_special_tokens=False)
            found = [e.ids for e in found]
            ids.append(np.fromiter((x for own in found for x in own), dtype="<u4"))
            counts += map(len, found)
        self.ids = np.concatenate(ids)
        self.offsets = np.append(self.offsets, self.offsets[-1] + np.cumsum(counts, dtype=np.int64))
        self.numbers = np.insert(self.numbers, place, np.arange(n, n + len(hashes), dtype=np.int32))
        self.hashes = np.insert(self.hashes, place, hashes)
        self.long.update((n + i, p) for i, p in enumerate(pieces) if len(p) > PACKED)
        self.low, self.high = np.append(self.low, low), np.append(self.high, high)
        self.size = np.append(self.size, np.array([len(p) for p in pieces], dtype=np.int32))

    def lookup(self, pieces: Words, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The pre-token of each piece, and the pieces whose bytes differ from it because their hashes collide."""
        low, high = spelled = packed(pieces)
        size = pieces.end - pieces.start
        hashes, at, which = np.unique(word_hashes(pieces, spelled), return_index=True, return_inverse=True)
        if len(self.hashes) + len(hashes) > _KNOWN:
            self.forget()
        place, there = self.met(hashes)
        if not there.all():
            new = at[~there]
            texts = [raw[s:e] for s, e in zip(pieces.start[new].tolist(), pieces.end[new].tolist(), strict=True)]
            self.learn(place[~there], hashes[~there], texts, low[new], high[new])
            place, _ = self.met(hashes)
        piece = self.numbers[place].astype(np.int64)
        other = (low[at] != self.low[piece]) | (high[at] != self.high[piece]) | (size[at] != self.size[piece])
        for i in np.flatnonzero(~other & (size[at] > PACKED)).tolist():
            other[i] = raw[pieces.start[at[i]] : pieces.end[at[i]]] != self.long[int(piece[i])]
        return piece[which], np.flatnonzero(other[which] | differing(pieces, spelled, at[which]))

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4")

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        apart = [b"\x00" in t or any(s in t for s in self.special) for t in texts]
        joined = b"\x00".join(b"" if odd else t for t, odd in zip(texts, apart, strict=True)) + b"\x00"
        plain = joined.decode("utf-8", "replace")
        codes = np.frombuffer(plain.encode("utf-32-le"), dtype="<u4")
        kinds = np.full(len(codes), _ODD, dtype=np.uint8)
        near = codes < len(_CLASSES)
        kinds[near] = _CLASSES[codes[near]]
        kinds[codes == 0] = _BREAK
        breaks = np.flatnonzero(kinds == _BREAK)
        for d in np.unique(np.searchsorted(breaks, np.flatnonzero(kinds == _ODD))).tolist():
            apart[d] = True
        start = piece_starts(codes, kinds)
        end = np.append(start[1:], len(codes))
        first = np.append(0, np.searchsorted(start, breaks) + 1)
        raw = plain.encode()
        place = np.append(0, np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)))
        piece, other = self.lookup(Words(np.frombuffer(raw, dtype=np.uint8), place[start], place[end], first), raw)
        for d in np.unique(np.searchsorted(breaks, start[other])).tolist():
            apart[d] = True
        begin, length = self.offsets[piece], self.offsets[piece + 1] - self.offsets[piece]
        length[np.searchsorted(start, breaks)] = 0
        stop = np.cumsum(length)
        ids = self.ids[np.arange(stop[-1]) + np.repeat(begin - (stop - length), length)]
        edge = np.append(0, stop)[first].tolist()
        return [self.whole(t) if odd else ids[a:b] for t, odd, a, b in zip(texts, apart, edge[:-1], edge[1:], strict=True)]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per Python worker; the path must lead to the same file on every machine."""
    return Encoder(path)


def encode(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """(doc_id, ids): little-endian unsigned 32-bit ids with the end id."""
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for part, texts in steps(batches):
            ids = [x.tobytes() + last for x in own.encode(texts)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def count_ids(encoded: DataFrame) -> DataFrame:
    """(id, n), counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for part in slices(batches, "ids"):
            more = np.bincount(binary_parts(part.column("ids"))[0].view("<u4"))
            if len(more) > len(total):
                total, more = more, total
            total[: len(more)] += more
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


#: Lengths of the four ranks of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
LENGTHS.setflags(write=False)


def pack(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of lists of ranks that follow each other, each with the offsets of the lists in them."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    extra = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    room = np.append(0, np.cumsum(-(-counts // 4)))
    padded = np.zeros(4 * room[-1], dtype=np.uint8)
    padded[slots(counts, room)] = extra
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    size = np.append(0, np.cumsum(extra.astype(np.int64) + 1))
    return control, room, data, size[np.append(0, np.cumsum(counts))]


def slots(counts: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The place of every rank among the two-bit fields of all control bytes."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(4 * room[:-1] - (ends - counts), counts)


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranks of all lists: lengths by table lookup, places by a running sum."""
    room = np.append(0, np.cumsum(-(-counts // 4)))
    length = LENGTHS[control].reshape(-1)[slots(counts, room)]
    begin = np.cumsum(length) - length
    ranks = np.zeros(len(length), dtype=np.uint32)
    for k in range(4):
        at = np.flatnonzero(length > k)
        if len(at):
            ranks[at] |= data[begin[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def checksums(ids: np.ndarray, counts: np.ndarray) -> list[int]:
    raw, ends = memoryview(np.ascontiguousarray(ids, dtype="<u4").view(np.uint8)), (4 * np.cumsum(counts)).tolist()
    return [crc(raw[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end: int = END) -> None:
    """Write the files of `docs` below `path`."""
    spark = docs.sparkSession
    ids = scratch_path(spark, "token_ids")
    encode(docs, tokenizer, doc_id=doc_id, text=text, end=end).write.option("compression", "zstd").parquet(ids)
    encoded = spark.read.schema("doc_id long, ids binary").parquet(ids)
    rank = F.row_number().over(Window.orderBy(F.col("n").desc(), "id")) - 1
    # at most a row per id of the vocabulary
    count_ids(encoded).withColumn("rank", rank).select(F.col("rank").cast("long"), "id", "n").coalesce(1).write.parquet(f"{path}/ranks")
    by_rank = read_ranks(spark, path)
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, dtype=np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # ids below the first bound, and null, go to part 0, ids from the last one on to the last part
    shares = [k / parts for k in range(1, parts)]
    bounds = np.array(encoded.agg(F.percentile_approx("doc_id", shares, 100 * parts)).first()[0] or [], dtype=np.int64) if shares else np.empty(0, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            data, offsets = binary_parts(batch.column("ids"))
            ids, counts = data.view("<u4"), np.diff(offsets) // 4
            control, room, coded, edge = pack(shared.value[ids], counts)
            doc = batch.column("doc_id")
            part = np.searchsorted(bounds, doc.fill_null(np.iinfo(np.int64).min).to_numpy(), side="right").astype(np.int32)
            columns = [pa.array(part), doc, pa.array(counts), pa.array(checksums(ids, counts), pa.int64()), binary_column(control, room), binary_column(coded, edge)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "n_tokens", "checksum", "control", "data"])

    coded = encoded.mapInArrow(run, "part int, doc_id long, n_tokens long, checksum long, control binary, data binary")
    ordered = coded.repartitionById(parts, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "checksum")
    ordered.write.option("compression", "zstd").parquet(f"{path}/tokens")


def read_ranks(spark: SparkSession, path: str) -> np.ndarray:
    """The id of each rank; as long as the vocabulary at most."""
    rows = spark.read.schema("rank long, id long, n long").parquet(f"{path}/ranks").select("rank", "id").toPandas().sort_values("rank")
    return rows["id"].to_numpy(dtype=np.int64)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(part, doc_id, start, n_tokens, ids, ids_crc32) from the files; start counts the ids of all documents before."""
    shared = spark.sparkContext.broadcast(read_ranks(spark, path).astype("<u4"))
    rows = spark.read.schema("part int, doc_id long, n_tokens long, checksum long, control binary, data binary").parquet(f"{path}/tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "data"):
            counts = part.column("n_tokens").to_numpy()
            ids = shared.value[unpack(binary_parts(part.column("control"))[0], binary_parts(part.column("data"))[0], counts)]
            sums = checksums(ids, counts)
            if sums != part.column("checksum").to_pylist():
                raise ValueError(f"damaged token file below {path}")
            columns = [part.column("part"), part.column("doc_id"), part.column("n_tokens"), binary_column(ids.view(np.uint8), 4 * np.append(0, np.cumsum(counts))), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "n_tokens", "ids", "ids_crc32"])

    return rows.mapInArrow(run, "part int, doc_id long, n_tokens long, ids binary, ids_crc32 long")


def with_starts(rows: DataFrame) -> DataFrame:
    """`rows` (part, doc_id, n_tokens, ...) with start; parts are few, and each is as long as one file."""
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    order = [F.col("doc_id").asc_nulls_first(), "n_tokens", "ids_crc32"]
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("own", own - F.col("n_tokens")).join(before, "part").withColumn("start", F.col("before") + F.col("own")).drop("own", "before")


def round_trip(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end: int = END, path: str | None = None) -> DataFrame:
    """Write the files, read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, doc_id=doc_id, text=text, end=end)
    return with_starts(read_tokens(spark, path).drop("ids")).select("doc_id", "start", "n_tokens", "ids_crc32")
