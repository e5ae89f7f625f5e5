"""Words of many texts at once, on the bytes of their UTF-8: every separator is one ASCII byte."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import xxhash

#: `[^\x20\x09-\x0D]+`
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[0x00:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Words(NamedTuple):
    """`data[start[i]:end[i]]` is word i; document d has the words first[d] to first[d + 1] - 1."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def split_words(texts: Sequence[bytes], separators: np.ndarray, lower: bool = False) -> Words:
    raw = b" " + b" ".join(texts) + b" "
    data = np.frombuffer(raw, dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    apart = separators[data]
    edge = np.flatnonzero(apart[1:] != apart[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    places = np.concatenate([[1], 1 + np.cumsum(lengths)])
    return Words(data, start, end, np.searchsorted(start, places))


def words_between(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray) -> Words:
    """Words of bytes that lie one after the other, each ending in a separator: text d is data[bounds[d]:bounds[d + 1]]."""
    apart = np.concatenate([[True], separators[data]])
    edge = np.flatnonzero(apart[1:] != apart[:-1])
    start, end = edge[0::2], edge[1::2]
    return Words(data, start, end, np.searchsorted(start, bounds))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Words of more bytes are hashed one by one.
PACKED = 16
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def packed(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of each word as two numbers, zeros behind its end: with the length they spell words that short."""
    data = np.concatenate([words.data, np.zeros(PACKED, dtype=np.uint8)])
    every = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    size = words.end - words.start
    low = every[words.start] & _KEEP[np.minimum(size, 8)]
    high = every[words.start + 8 * (size > 8)] & _KEEP[np.clip(size - 8, 0, 8)]
    return low, high


def word_hashes(words: Words, spelled: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """64 bits of each word: a mix of the bytes and the length of short words, xxh3 of others; `spelled` is packed(words)."""
    size = (words.end - words.start).astype(np.uint64)
    low, high = spelled or packed(words)
    out = mix(mix(low + size * np.uint64(0xD6E8FEB86659FD93)) + high * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
    long = np.flatnonzero(size > PACKED)
    if len(long):
        raw = memoryview(np.ascontiguousarray(words.data))
        spans = zip(words.start[long].tolist(), words.end[long].tolist(), strict=True)
        out[long] = np.fromiter((xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in spans), dtype=np.uint64, count=len(long))
    return out


def differing(words: Words, spelled: tuple[np.ndarray, np.ndarray], lead: np.ndarray) -> np.ndarray:
    """Which words are not, byte for byte, the word `lead` of each; `spelled` is packed(words)."""
    low, high = spelled
    size = words.end - words.start
    out = (low != low[lead]) | (high != high[lead]) | (size != size[lead])
    rest = np.flatnonzero(~out & (size > PACKED) & (lead != np.arange(len(lead))))
    short = rest[size[rest] <= 1 << 12]
    n = size[short]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    apart = words.data[np.repeat(words.start[short], n) + step] != words.data[np.repeat(words.start[lead[short]], n) + step]
    out[np.repeat(short, n)[apart]] = True
    for i in rest[size[rest] > 1 << 12].tolist():
        first = lead[i]
        out[i] = not np.array_equal(words.data[words.start[i] : words.end[i]], words.data[words.start[first] : words.end[first]])
    return out


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """64 bits of each run of `size` words, in order; runs that cross documents are the caller's to leave out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[k : k + n]
    return mix(out)
