import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import mixing, vector_search
from tests.llm.frames import SCHEMA, documents, prose


def frame(spark):
    rows = [(k, prose(k, 10 + k % 40), None, None if k % 11 == 0 else f"s{min(k % 12, 5)}", 1) for k in range(400)] + documents()
    return spark.createDataFrame(rows, SCHEMA), rows


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w)


def test_mix_meets_its_targets(spark):
    df, rows = frame(spark)
    out = mixing.mix(df.withColumn("epoch", F.lit("own")), entropy=0.97, repeats=3.0).collect()
    words = lambda t: len((t or "").replace("\x0b", " ").replace("\x0c", " ").replace("\x1c", "_").split())
    tokens = defaultdict(int)
    for _, t, _, s, _ in rows:
        tokens[s] += words(t)
    weights = {r.source: r.weight for r in out}
    total = sum(tokens.values())
    assert math.isclose(sum(weights.values()), 1.0, abs_tol=1e-9)
    got = Counter()
    for r in out:
        got[r.source] += r.n_tokens
    assert max(weights[s] * total / n for s, n in tokens.items()) <= 3.0
    longest = max(words(t) for _, t, *_ in rows)
    for s in tokens:
        assert weights[s] * total - longest < got[s] <= weights[s] * total + 1e-6
    assert all(0 <= r.position < 1.0001 for r in out)
    reached = entropy(weights.values()) >= 0.97 * math.log(len(tokens)) - 1e-6
    assert reached or max(weights[s] * total / n for s, n in tokens.items()) > 2.99


def test_every_document_comes_at_least_once(spark):
    df, rows = frame(spark)
    out = mixing.mix(df, budget_share=None, entropy=0.97, repeats=3.0)
    assert out.columns == [*df.columns, "n_tokens", "weight", "epoch", "block", "position"]
    got = Counter(tuple(r)[:5] for r in out.filter("epoch = 0").collect())
    assert got == Counter(rows)
    assert out.count() > len(rows)


def test_rounding_leaves_no_source_without_an_epoch(spark, monkeypatch):
    monkeypatch.setattr(mixing, "best_exponent", lambda *_: 0.6)
    for most in (10**15 + 7, 10**15 + 11, 10**15 + 123_457, 10**15 + 987_653):
        measured = spark.createDataFrame([("=a", most), ("=b", most // 3), ("=c", most // 17 + 1)], "key string, n long")
        planned = mixing.plan_sources(measured, None, 0.97, 4.0).collect()
        assert all(r.epochs >= 1 and r.budget >= r.n for r in planned)


@pytest.mark.parametrize("rows", [[], [(1, None, None, "a", 1)], [(1, "x y", None, "a", 1), (2, "", None, None, 1)]])
def test_mix_of_little(spark, rows):
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.doc_id for r in out.collect()) == [r[0] for r in rows]


def brute(rows, k):
    usable = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    dims = Counter(len(v) for _, v in usable)
    dim = max(dims, key=lambda d: (dims[d], -d))
    usable = [(i, v) for i, v in usable if len(v) == dim]
    out = {}
    for q, x in usable:
        if q % 20 == 0:
            scored = sorted(((-float((v * x).sum()), i) for i, v in usable if i != q))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df, k=20):
    out, ranks = defaultdict(list), defaultdict(list)
    for r in sorted(vector_search.search(df, F.col("vec_id") % 20 == 0, k=k).collect(), key=lambda r: (r.query_id, r.row, r.rank)):
        out[r.query_id].append((r.vec_id, r.score))
        ranks[r.query_id, r.row].append(r.rank)
    assert all(x == list(range(1, len(x) + 1)) for x in ranks.values())
    return dict(out)


def test_odd_vectors_take_no_part(spark):
    rng = np.random.default_rng(1)
    rest = [0.0, 0.0, 0.0]
    rows = [(k, rng.normal(size=4).round(2).tolist()) for k in range(12)]
    rows += [(20, [1.0, *rest]), (40, None), (60, [0.0, *rest]), (80, [1.0, None, 0.0, 0.0]), (100, [float("nan"), *rest])]
    rows += [(120, [float("inf"), *rest]), (140, [1.0, 2.0]), (None, [1.0] * 4), (160, []), (20, [0.5, *rest])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, shard string")
    got = {q: [i for i, _ in x] for q, x in found(df, 40).items() if q != 20}
    assert got == {q: [i for i, _ in x] for q, x in brute(rows, 40).items() if q != 20}


def test_ties_go_to_the_smaller_id(spark):
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(300)] + [(k, [3.0, 1.0, float(k % 5)]) for k in range(300, 400)]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == brute(rows, 20)


def test_recall(spark, base):
    for scale in (1.0, None):
        df = spark.read.parquet(base.replace("sf0.001", "sf0.1") + "/embeddings.parquet").select("vec_id", "embedding")
        if scale is None:
            df = df.withColumn("embedding", F.transform("embedding", lambda x: x * (1 + F.col("vec_id") % 3)))
        rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]
        want, got = brute(rows, 20), found(df)
        assert want.keys() == got.keys()
        hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
        assert hits >= 0.9 * sum(map(len, want.values()))
        exact = {(q, i): s for q in want for i, s in want[q]}
        assert all(math.isclose(s, exact[q, i], rel_tol=1e-12) for q in got for i, s in got[q] if (q, i) in exact)


def test_opposed_vectors_are_found(spark):
    rng = np.random.default_rng(2)
    for n in (21, 25):
        around = rng.normal(size=(n, 8))
        around /= np.sqrt((around * around).sum(axis=1))[:, None]
        rows = [(20 * k, v) for k, v in enumerate(around.tolist())]
        got, want = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), brute(rows, 20)
        assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
        if n == 21:
            assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}


def test_one_very_long_vector(spark):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=32) * (1000 if k == 7 else 1)).tolist()) for k in range(2000)]
    got, want = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), brute(rows, 20)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 20 * len(want)


def test_no_vectors(spark):
    assert found(spark.createDataFrame([], "vec_id long, embedding array<float>")) == {}


def test_repeated_query_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(1, 60)]
    other = rng.normal(size=8).tolist()
    same = rows[19]
    df = spark.createDataFrame([*rows, same, same, (40, other)], "vec_id long, embedding array<double>")
    got = found(df, 5)
    # given thrice, the row is one query; rows of its own id are no neighbours
    scored = sorted((-float(np.dot(v, same[1])), i) for i, v in [*rows, (40, other)] if i != 20)
    assert [i for i, _ in got[20]] == [i for _, i in scored[:5]]
    # two vectors of one id are two queries
    want = []
    for x in (rows[39][1], other):
        near = sorted((-float(np.dot(v, x)), i) for i, v in [*rows, same, same] if i != 40)
        want += [i for _, i in near[:5]]
    assert sorted(i for i, _ in got[40]) == sorted(want)
