import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from holdfast.llm import importance
from holdfast.llm.words import NOT_ALNUM, split_words
from tests.llm.frames import SCHEMA, documents, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def brute(rows, target):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    big_s, big_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * big_s / ((s[b] + 1.0) * big_t))) for b in s}
    out = []
    for d, text in rows:
        n, f = features(text)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[bucket(x)] for x in f)
        out.append((n, d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    drawn = sorted((r for r in out if r[0] >= 20), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[3], r[2]))
    top = Counter()
    ranked = []
    for k, r in enumerate(drawn[: 5 * len(drawn) // 100]):
        top[r] += 1
        ranked.append((*r[1:], k + 1))
    rest = list((Counter(out) - top).elements())
    return sorted(ranked + [(*r[1:], None) for r in rest], key=str)


def rows_of(spark, rows, target, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    return sorted((tuple(r) for r in importance.resample(docs, bench, **more).collect()), key=str)


TARGET = [prose(99, 60), prose(5, 15), None, "", "The street; thest" + "a" * 70]


def corpus():
    long = "a" * 70 + " " + "b" * 17 + " " + "c" * 200 + " The " + "d" * 16
    more = [(100 + k, prose(1000 + k, 30 + k)) for k in range(60)] + [(300, long + " " + prose(3, 20)), (301, "ÄÖ-Ü A_b\x00c " * 9)]
    return [(d, t) for d, t, *_ in documents()] + more


def test_rows_equal_brute_force(spark):
    rows = corpus()
    assert rows_of(spark, rows, TARGET) == brute(rows, TARGET)


def test_small_head_changes_nothing(spark, monkeypatch):
    rows = corpus()
    heads = importance.head_of
    monkeypatch.setattr(importance, "head_of", lambda texts: heads(texts, words=6, pairs=4))
    assert rows_of(spark, rows, TARGET) == brute(rows, TARGET)


def test_crc_of_features():
    texts = [b"the cat sat on the mat the cat", b"", b"x" * 100 + b" the cat " + b"y" * 65, b"one"]
    words = split_words(texts, NOT_ALNUM, lower=True)
    spelled = [words.data[s:e].tobytes() for s, e in zip(words.start, words.end, strict=True)]
    keys = importance.packed(words)
    some = np.array([0, 1, 4])
    table = importance.table_of(keys[0][some], keys[1][some], np.array([zlib.crc32(spelled[i]) for i in some], dtype=np.uint32))
    for n, (place, crc) in enumerate(importance.crcs(words, importance.Head(table, importance.NO_PAIRS)), 1):
        assert [zlib.crc32(b" ".join(spelled[p : p + n])) for p in place] == crc.tolist()


def test_summary_keeps_frequent_keys():
    held, rng = importance.Summary(8), np.random.default_rng(3)
    keys = rng.permutation(np.concatenate([np.arange(2000), np.full(600, 5000)])).astype(np.uint64)
    for part in np.array_split(keys, 13):
        held.add(part, part * np.uint64(3))
    assert 5000 in held.keys[:, 0].tolist() and len(held.counts) <= 8


def test_empty_tables_and_extra_columns(spark):
    assert rows_of(spark, [], TARGET) == []
    rows = [(d, t) for d, t, *_ in documents()]
    assert rows_of(spark, rows, []) == brute(rows, [])
    df = spark.createDataFrame([(*r, 1, "x") for r in documents()], SCHEMA + ", score int, part string")
    got = importance.resample(df, spark.createDataFrame([(t, 0) for t in TARGET], "text string, rank int"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, TARGET)
