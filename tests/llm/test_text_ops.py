import hashlib
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from holdfast.llm import decontaminate, super_kmers, words
from tests.llm.frames import SCHEMA, documents, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@given(st.lists(st.text(alphabet="ab \t\x0béZ9 -", max_size=12), max_size=6))
def test_words_equal_the_pattern(texts):
    raw = [t.encode() for t in texts]
    for separators, pattern, lower in ((words.SPACES, r"[^\x20\x09-\x0D]+", False), (words.NOT_ALNUM, ALNUM, True)):
        w = words.split_words(raw, separators, lower)
        data = w.data.tobytes()
        for d, text in enumerate(texts):
            got = [data[s:e].decode() for s, e in zip(w.start[w.first[d] : w.first[d + 1]], w.end[w.first[d] : w.first[d + 1]], strict=True)]
            assert got == re.findall(pattern, text.translate(LOWER) if lower else text)


def test_hashes_do_not_depend_on_place():
    w = words.split_words([b"x" * 3_000_000 + b" ab", b"cd ab", b"ab" + b" pad" * 600_000 + b" ab"], words.SPACES)
    h = words.word_hashes(w)
    data = w.data.tobytes()
    same = {h[i] for i in range(len(h)) if data[w.start[i] : w.end[i]] == b"ab"}
    assert len(same) == 1 and len(np.unique(h)) == 4


def runs_removed(rows, width):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_equals_brute_force(spark):
    rows = documents()
    rows += [(30 + k, prose(500 + k, 20) + " " + " ".join(["same"] * (5 * k)) + " " + prose(77, 40 - k), None, None, None) for k in range(10)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in super_kmers.digest(super_kmers.dedup_substrings(df)).collect()), key=str)
    assert got == runs_removed([r[:2] for r in rows], 13)


def test_marks_do_not_depend_on_batches(spark, monkeypatch):
    rows = [(k, prose(k % 7, 60) + " " + prose(1000 + k, 10)) for k in range(60)]
    monkeypatch.setattr(super_kmers, "JUDGE_ROWS", 7)
    monkeypatch.setattr(super_kmers, "SEND_BYTES", 600)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in super_kmers.digest(super_kmers.dedup_substrings(df)).collect()), key=str)
    assert got == runs_removed(rows, 13)


def test_substring_dedup_of_nothing(spark):
    assert super_kmers.dedup_substrings(spark.createDataFrame([], SCHEMA)).collect() == []


def contaminated(rows, items, width):
    windows = {}
    for item, text in items:
        w = re.findall(ALNUM, (text or "").translate(LOWER))
        n = min(width, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for d, text in rows:
        w = re.findall(ALNUM, (text or "").translate(LOWER))
        hit, found = set(), set()
        for n in range(1, width + 1):
            for i in range(len(w) - n + 1):
                ids = windows.get(tuple(w[i : i + n]))
                if ids is not None:
                    hit.update(range(i, i + n))
                    found.update(ids)
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((d, len(w), len(hit), len(found - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [
    (1, prose(99, 30)), (2, prose(1, 25)), (2, prose(1, 25)), (3, "single"), (4, None), (5, "-- "), (6, "x x x"), (None, prose(5, 12)), (7, prose(10, 9)), (8, prose(10, 10)),
    (9, prose(99, 12)), (10, "thest reST"),
]


@pytest.mark.parametrize("block_items", [1000, 3])
def test_decontamination_equals_brute_force(spark, block_items):
    rows = [(d, (t or "")[:2000] if d == 12 else t) for d, t, *_ in documents()]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, items string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.find_benchmark(df, bench, block_items=block_items)
    assert sorted((tuple(r) for r in decontaminate.digest(found).collect()), key=str) == contaminated(rows, ITEMS, 10)


def test_decontamination_without_items_or_documents(spark):
    df = spark.createDataFrame(documents(), SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.digest(decontaminate.find_benchmark(df, none)).filter("contaminated").count() == 0
    assert decontaminate.find_benchmark(df.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []
