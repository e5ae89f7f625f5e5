import random

import numpy as np
import pytest

from holdfast.llm import near_dup, part_enum
from tests.llm.frames import SCHEMA, documents, prose
from tests.llm.test_near_dup import brute


def linked(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = part_enum.join(df, **how)
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()), key=str)


def corpus():
    words = prose(31, 200).split(" ")
    rows = [(1000 + k, " ".join(f"w{k}x{i}" if i < 2 * k else w for i, w in enumerate(words))) for k in range(20)]
    rows += [(1100 + k, " ".join(words[: 190 + k])) for k in range(10)] + [(1200 + k, prose(300 + k, 60)) for k in range(30)]
    # chains of near copies of many sizes, down to a few words
    rng = random.Random(4)
    for n in (5, 6, 7, 9, 12, 18, 30, 64, 100, 101, 140, 400):
        base = prose(5000 + n, n).split(" ")
        for k in range(6):
            at = rng.randrange(len(base))
            base = base[:at] + [f"n{n}k{k}"] + base[at + rng.choice([0, 1, 2]) :]
            rows.append((2000 + 10 * n + k, " ".join(base)))
    passage = prose(88, 40)
    return rows + [(9000 + k, prose(900 + 2 * k, 30) + " " + passage + " " + prose(901 + 2 * k, 25)) for k in range(20)]


@pytest.mark.parametrize(("size", "percent"), [(5, 80), (2, 80), (1, 60)])
def test_components_equal_brute_force(spark, size, percent):
    rows = corpus() + [(d, t) for d, t, *_ in documents()]
    assert linked(spark, rows, size=size, percent=percent) == brute(rows, size, percent)


def test_lists_compared_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "STAR_ROUNDS", 0)
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    rows = corpus()
    assert linked(spark, rows) == brute(rows, 5, 80)


def test_all_pairs_confirmed_in_the_end(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "STAR_ROUNDS", 0)
    monkeypatch.setattr(near_dup, "NEAREST_ROUNDS", 0)
    rows = corpus()
    assert linked(spark, rows) == brute(rows, 5, 80)


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_similar_sets_share_a_signature(percent):
    views = part_enum.views_of(percent, 4000)
    rng = np.random.default_rng(percent)
    met = 0
    for trial in range(1500):
        n = int(rng.integers(1, (12, 60, 900)[trial % 3]))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        loss = (100 - percent) / 100
        less, more = int(rng.integers(0, n * loss + 1)), int(rng.integers(0, n * loss / (1 - loss) + 2))
        b = np.unique(np.concatenate([rng.permutation(a)[less:], rng.integers(0, 2**63, more).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
            met += 1
            one, two = part_enum.signatures([a, b], views, percent)
            assert len(np.intersect1d(one, two))
    assert met > 200


def test_shared_rows_over_batches(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(40), rng.randrange(9)) for _ in range(120)] + [(77, k) for k in range(500)] + [(78, 5)] * 30 + [(k + 1000, k) for k in range(50)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = part_enum.shared(spark.createDataFrame(rows, "list long, alias long")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    lists = {}
    for a, b in rows:
        lists.setdefault(a, set()).add(b)
    assert sorted(map(tuple, got)) == sorted((a, b) for a, s in lists.items() if len(s) > 1 for b in s)


def test_empty_table_and_extra_columns(spark):
    assert linked(spark, []) == []
    df = spark.createDataFrame([(*r, 1, "x") for r in documents()], SCHEMA + ", node int, list string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in part_enum.join(df).collect()), key=str)
    assert got == brute([(d, t) for d, t, *_ in documents()], 5, 80)


def test_words_that_a_polynomial_confuses(spark):
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{a} x"), (2, f"{b} x"), (3, f"{a} x")]
    assert [r[2] for r in linked(spark, rows)] == [1, 2, 1]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_dup.link(df, size=2).collect()) == [(1, 1), (2, 2), (3, 1)]
