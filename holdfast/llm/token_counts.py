"""Token counts of a unigram model by dynamic programming shared along a trie.

A pre-token is a word behind the mark for a space.  Its best segmentation into pieces of the vocabulary is found from left to
right, and the state after each prefix does not depend on what follows.  So distinct pre-tokens go into a trie whose nodes
hold that state (best log-probability, pieces used), computed once for all words that share the prefix; where a pre-token ends
its node holds the count that every further occurrence takes.  Of equal scores the segmentation with fewer pieces counts.

A node leads to its children by one character each and holds its state.  Backward, the pieces that end somewhere are found by
walking a trie of reversed pieces from there until no piece goes on.

The trie lives in a task and is started anew beyond NODES nodes, which changes no count.  What a word has beyond DEPTH
characters goes through the same recurrence without new nodes, with the states of the longest piece's length at hand, so that
memory stays small however long a text without spaces is.  Counts of whole words are remembered by their bytes from one step
to the next.  Nothing is shuffled: a document's count needs its own words only.

The vocabulary is a public file of pieces in order of rank; the probability of rank r is taken in proportion to 1 / (r + 1).
Characters outside all pieces count as their UTF-8 bytes, each less likely than any piece by the factor BYTE.

Defined cases: null, empty and blank texts have no words and no tokens; repeated rows count alike; other columns stay as they
are, and a column whose name clashes with a result is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import steps
from .words import SPACES, split_words

NODES = 600_000
DEPTH = 64
#: Words whose counts a task remembers.
REMEMBERED = 500_000
BYTE = math.exp(-10.0)
MARK = "▁"


def read_pieces(path: str) -> dict[str, float]:
    """Log-probability of each ordinary piece of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranked = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(ranked))))
    return {piece: -math.log(r + 1) - total for r, piece in enumerate(ranked)}


class Trie:
    """Prefixes of pre-tokens with the forward state after each."""

    def __init__(self, pieces: dict[str, float], limit: int = NODES) -> None:
        self.limit = limit
        self.longest = max(map(len, pieces), default=1)
        self.byte = min(pieces.values(), default=0.0) + math.log(BYTE)
        # pieces by their characters from the last to the first: (children by character, log-probability if a piece ends)
        ends: list = [{}, None]
        for piece, odds in pieces.items():
            node = ends
            for c in reversed(piece):
                node = node[0].setdefault(c, [{}, None])
            node[1] = odds
        self.ends: dict = ends[0]
        self.words: dict[bytes, tuple[float, int]] = {}
        self.forget()

    def forget(self) -> None:
        """A node is [children by character or None, score, pieces used]."""
        self.root: list = [None, 0.0, 0]
        self.nodes = 1

    def count(self, token: str) -> tuple[float, int]:
        if self.nodes > self.limit:
            self.forget()
        node, path = self.root, [self.root]
        for c in token:
            children = node[0]
            node = children.get(c) if children is not None else None
            if node is None:
                return self.insert(token, path)
            path.append(node)
        return path[-1][1], path[-1][2]

    def insert(self, token: str, path: list[list]) -> tuple[float, int]:
        """`path` has the nodes of the prefixes that are there already; the others are added."""
        ends, keep = self.ends, 2 * self.longest
        # path[i] is the state after skipped + i characters
        skipped = 0
        above = path[-1]
        _, score, used = above
        for end in range(len(path), len(token) + 1):
            last = token[end - 1]
            node = ends.get(last)
            if node is None:
                n = len(last.encode("utf-8", "replace"))
                score, used = score + n * self.byte, used + n
            else:
                children, odds = node
                if odds is None:
                    n = len(last.encode("utf-8", "replace"))
                    score, used = score + n * self.byte, used + n
                else:
                    score, used = score + odds, used + 1
                at = end - 2
                while at >= 0:
                    node = children.get(token[at])
                    if node is None:
                        break
                    children, odds = node
                    if odds is not None:
                        before = path[at - skipped]
                        total = before[1] + odds
                        if total > score or total == score and before[2] < used - 1:
                            score, used = total, before[2] + 1
                    at -= 1
            state = [None, score, used]
            if end <= DEPTH:
                if above[0] is None:
                    above[0] = {last: state}
                else:
                    above[0][last] = state
                self.nodes += 1
            above = state
            path.append(state)
            if len(path) > DEPTH + 2 * keep:
                del path[:keep]
                skipped += keep
        return score, used

    def counts(self, words: list[bytes]) -> list[tuple[float, int]]:
        """The counts of distinct words."""
        known = self.words
        found = list(map(known.get, words))
        # sorted, so that words which share a prefix follow each other
        fresh = sorted((words[i].decode("utf-8", "replace"), i) for i, state in enumerate(found) if state is None)
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
        for word, i in fresh:
            found[i] = state = self.count(MARK + word)
            if len(words[i]) <= DEPTH:
                self.words[words[i]] = state
        return found


@lru_cache(maxsize=1)
def trie(path: str, limit: int) -> Trie:
    """One per Python worker; the path must lead to the same file on every machine."""
    return Trie(read_pieces(path), limit)


def count_tokens(docs: DataFrame, vocabulary: str, *, text: str = "text", nodes: int = NODES) -> DataFrame:
    """`docs` with n_words, n_tokens and log_prob (of the best segmentation)."""
    results = ("n_words", "n_tokens", "log_prob")
    kept = [c for c in docs.columns if c not in results or c == text]
    schema = T.StructType([docs.schema[c] for c in kept]).add("n_words", T.LongType()).add("n_tokens", T.LongType()).add("log_prob", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trie(vocabulary, nodes)
        for part, texts in steps(batches, text):
            words = split_words(texts, SPACES)
            raw = words.data.tobytes()
            spelled = pa.array([raw[a:b] for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)], pa.binary()).dictionary_encode()
            state = own.counts(spelled.dictionary.to_pylist())
            at, first = spelled.indices.to_numpy(), words.first
            score = np.array([s for s, _ in state], dtype=np.float64)[at].tolist()
            used = np.append(0, np.cumsum(np.array([u for _, u in state], dtype=np.int64)[at]))
            edges = first.tolist()
            columns = [
                *(part.column(c) for c in kept), pa.array(np.diff(first), pa.int64()), pa.array(np.diff(used[first]), pa.int64()),
                pa.array([math.fsum(score[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*kept).mapInArrow(run, schema)
