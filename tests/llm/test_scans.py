import random
import time

import pytest

from holdfast.llm import decontaminate, toxicity


def plain_segments(positions, scores, drift):
    """The same candidates, each searched for from the right."""
    out, total, at = [], 0.0, 0
    for p, s in zip(positions, scores, strict=True):
        total -= drift * (p - at)
        before, total, at = total, total + s, p + 1
        if s <= 0:
            continue
        low, high, first = before, total, p
        while True:
            smaller = [j for j in range(len(out)) if out[j][0] < low]
            if not smaller or out[smaller[-1]][1] >= high:
                out.append((low, high, first, p))
                break
            low, _, first, _ = out[smaller[-1]]
            del out[smaller[-1] :]
    return [(first, last, high - low) for low, high, first, last in out]


@pytest.mark.parametrize("seed", range(8))
def test_segments_of_random_scores(seed):
    rng = random.Random(seed)
    positions = sorted(rng.sample(range(900), 250))
    scores = [rng.choice([-2.0, -0.5, 0.25, 0.5, 1.0, 3.0]) for _ in positions]
    drift = rng.choice([0.0, 0.125, 0.5])
    assert toxicity.maximal_segments(positions, scores, drift) == plain_segments(positions, scores, drift)


def test_scan_is_linear():
    def seconds(n):
        start = time.perf_counter()
        assert len(toxicity.maximal_segments(list(range(0, 50 * n, 50)), [1.0] * n, 0.25)) == n
        return time.perf_counter() - start

    # quadratic work would take 16 times as long or more
    assert seconds(200_000) < 12 * max(seconds(50_000), 0.05)


def test_text_item_ids(spark):
    words = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"x y {words} z"), (2, "nothing of it"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("b-2", words), ("a/1", " ".join(words.split()[5:20])), ("none", None)], "item_id string, text string")
    for sizes in ({}, {"block_items": 1}):
        found = {r.doc_id: r["items"] for r in decontaminate.find_benchmark(docs, bench, **sizes).collect()}
        assert found == {1: ["a/1", "b-2"], 2: [], 3: []}
    assert decontaminate.digest(decontaminate.find_benchmark(docs, bench)).filter("contaminated").count() == 1
