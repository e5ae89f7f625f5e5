import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from holdfast.llm import burst_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def turn_key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def truncated(c, m):
    return int(abs(c) % m) * (1 if c >= 0 else -1)


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, turn_key(role or "", text or ""), role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(v, key=lambda t: t[:3])] for c, v in own.items()}
    out = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - truncated(c, 100), [])[:h] + t[h:]
    return out


def brute(rows):
    seqs = rebuilt(rows)
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = defaultdict(set)
    for path in members:
        if path:
            children[path[:-1]].add(path)

    def below(path):
        return [path] + [x for child in children[path] for x in below(child)]

    out = []
    for path, m in members.items():
        under = below(path)
        saved = sum((len(members[p]) - 1) * (len(p[-1][1]) if p else 0) for p in under)
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(m), len(path), parent, len(m), len(children[path]), sum(not children[p] for p in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed=5):
    rng = random.Random(seed)
    turns = [("user", "hello"), ("user", "hällo 😀"), ("system", "be kind"), (None, "x"), ("user", None), ("user", "")]
    rows = []
    for c in [*range(0, 12), *range(100, 160), 205, 299, -3, -100, -101, 7_000_000_000_050]:
        for k in range(rng.choice([0, 1, 2, 4, 6, 8])):
            rows.append((c, None if k == 0 and c % 3 == 0 else k, *rng.choice(turns[: 2 + c % 5])))
    long = [(300 + k, t, "user", f"turn {t}" if t < 40 or k < 3 else f"other {k}") for k in range(8) for t in range(60)]
    same = [(400 + k, t, "a", "same " * 3) for k in range(30) for t in range(3)]
    twice = [(500, 1, "user", "again"), (500, 1, "user", "again"), (500, 1, "a", "tie"), (500, 1, "b", "tie"), (None, 1, "user", "lost")]
    return rows + long + same + twice


def found(df, **limits):
    out = burst_trie.trie(burst_trie.rebuilt(df, burst_trie.beginning), **limits)
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("limits", [{}, {"container": 3}, {"container": 1}, {"container": 50, "turns": 40}])
def test_nodes_equal_brute_force(spark, limits):
    rows = conversations()
    assert found(spark.createDataFrame(rows, SCHEMA), **limits) == brute(rows)


def test_conversation_without_turns(spark):
    # CRC of "101" asks for more turns than 101 has, and 100 is absent
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(c, 0, "user", "only"), (c, 1, "user", "two")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_empty_table_and_extra_columns(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    rows = conversations(9)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", seq string, pos int")
    assert found(df, container=4) == brute(rows)
