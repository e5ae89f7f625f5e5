"""Toxicity by maximum-scoring segments.

Fit, on labelled documents only (at most about TRAIN_ROWS of them, chosen by a hash of the id; the bound is a parameter):
three of four give the token log-odds, the fourth calibrates.  A token is a word or one of its beginnings of 3 to 8 letters,
so inflections that training never saw count by their stem.  Log-odds are taken between toxic and clean documents under a
Dirichlet prior in proportion to the token's total count; tokens far from zero (Z_LEAST standard deviations, ODDS_LEAST)
make the model, at most MODEL_TOKENS of them, and as many tokens that are known to be neutral where a shorter one is not.  Documents that look like copies of each other (same least shingle hash and
label) share one vote.

Scoring, on every whole text: each word scores the log-odds of its most telling token, less a small drift, and one linear
scan finds all maximal scoring segments.  With the score distribution of clean words, extreme-value theory turns a segment of
score S in n words into lambda * S - ln(K * n); what is above zero is a significant passage.  Their sum is the evidence of
the document, and a logistic curve fitted on the calibration part makes it a score between 0 and 1.

Defined cases: null, empty and wordless texts have no evidence and get the score of that; documents without an id or
without a label are never learned from; a document with several labels is toxic if one says so, null labels do not count;
labelled rows of one class only, or none, leave all tokens out, and every score is the smoothed share of toxic rows; repeated
rows are scored alike; other columns stay as they are, and a column whose name clashes with a result is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import steps, written
from .near_dup import shingle_sets

TRAIN_ROWS = 20_000
MODEL_TOKENS = 50_000
PRIOR = 200.0
Z_LEAST = 3.0
ODDS_LEAST = 1.0
VOTES_LEAST = 3
#: Votes beyond which a token that tells nothing is taken to be neutral.
VOTES_SURE = 10
DRIFT = 0.1
REJECT = 0.7
#: One vote, in whole numbers so that sums do not depend on their order.
VOTE = 1_000_000
_CACHE = 200_000

_WORD = re.compile(r"[^\W\d_]+")
_SEGMENTS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


class Model(NamedTuple):
    weights: dict[str, tuple[float, float]]
    rate: float
    log_k: float
    intercept: float
    slope: float


def tokens_of(word: str) -> list[str]:
    """From the most to the least specific."""
    return ["=" + word, *(word[:k] for k in range(min(8, len(word)), 2, -1))]


def words_of(text: bytes) -> list[str]:
    return _WORD.findall(text.decode("utf-8", "replace").lower())


def word_weight(word: str, weights: dict[str, tuple[float, float]]) -> float:
    """Log-odds of the word's token that is farthest from zero in standard deviations, up to the first token that is known
    well enough to be neutral (of weight zero)."""
    best, far = 0.0, 0.0
    for token in tokens_of(word):
        found = weights.get(token)
        if found is None:
            continue
        if not found[1]:
            break
        if abs(found[0]) > far:
            best, far = found[1], abs(found[0])
    return best


def maximal_segments(positions: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score): words not listed score -drift.

    Candidates are kept with the running total before and after them; each new one merges with earlier candidates whose total
    before is smaller, as long as its own total after is larger.  Each knows the nearest earlier one whose total before is
    smaller, and all between are passed over at once, so the scan is linear.
    """
    out: list[tuple[float, float, int, int, int]] = []
    total, at = 0.0, 0
    for p, s in zip(positions, scores, strict=True):
        total -= drift * (p - at)
        before, total, at = total, total + s, p + 1
        if s <= 0:
            continue
        low, high, first = before, total, p
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][0] >= low:
                j = out[j][4]
            if j < 0 or out[j][1] >= high:
                out.append((low, high, first, p, j))
                break
            low, _, first, _, earlier = out[j]
            del out[j:]
            j = earlier
    return [(first, last, high - low) for low, high, first, last, _ in out]


class Scanner:
    """Word weights with a bounded memory of words met."""

    def __init__(self, weights: dict[str, tuple[float, float]]) -> None:
        self.weights, self.known = weights, {}

    def scan(self, text: bytes) -> tuple[int, np.ndarray, list[tuple[int, int, float]]]:
        words, known = words_of(text), self.known
        values = list(map(known.get, words))
        if None in values:
            if len(known) > _CACHE:
                known.clear()
            for i, v in enumerate(values):
                if v is None:
                    values[i] = known[words[i]] = word_weight(words[i], self.weights)
        scores = np.array(values, dtype=np.float64)
        at = np.flatnonzero(scores)
        own = scores[at]
        return len(words), own, maximal_segments(at.tolist(), (own - DRIFT).tolist(), DRIFT)


def evidence(n: int, segments: list[tuple[int, int, float]], rate: float, log_k: float) -> list[float]:
    return [rate * s - log_k - math.log(max(n, 1)) for _, _, s in segments]


def training_rows(docs: DataFrame, labels: DataFrame, learnable: Column, rows: int) -> DataFrame:
    """(text, toxic, calibrates) of at most about `rows` labelled documents, chosen by hash."""
    own = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    own = own.filter(learnable).withColumn("h", F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30)))
    share = min(1.0, rows / max(1, own.count()))
    chosen = own.filter(F.col("h") <= int(share * (1 << 30))).withColumn("calibrates", F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(4)) == 0)
    return docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen.drop("h")), "doc_id").drop("doc_id")


def with_copy_key(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches):
            keys = np.array([s[0] if len(s) else 0 for s in shingle_sets(texts, 2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys)], names=[*part.schema.names, "copy_key"])

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("copy_key", T.LongType())]))


def token_votes(rows: DataFrame) -> DataFrame:
    """(token, toxic, clean): votes of documents with the token; the empty token has the votes of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic, vote in zip(texts, part.column("toxic").to_pylist(), part.column("vote").to_pylist(), strict=True):
                own = counts[bool(toxic)]
                own[""] += vote
                for token in {t for w in set(words_of(text)) for t in tokens_of(w)}:
                    own[token] += vote
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *[pa.array([c.get(n, 0) for n in names], pa.int64()) for c in (counts[1], counts[0])]], names=["token", "toxic", "clean"]
            )

    return rows.mapInArrow(run, "token string, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit_weights(votes: DataFrame, model_tokens: int) -> dict[str, tuple[float, float]]:
    all_votes = votes.filter("token = ''").first()
    if all_votes is None or not all_votes["toxic"] or not all_votes["clean"]:
        return {}
    n1, n0 = all_votes["toxic"] / VOTE, all_votes["clean"] / VOTE
    y1, y0 = F.col("toxic") / VOTE, F.col("clean") / VOTE
    a = F.lit(PRIOR) * (y1 + y0) / (n1 + n0)
    odds = lambda y, n: F.log((y + a) / (F.lit(n + PRIOR) - y - a))
    scored = votes.filter((F.col("token") != "") & (y1 + y0 >= VOTES_LEAST) & (y1 + y0 < 0.999 * (n1 + n0))).withColumn("odds", odds(y1, n1) - odds(y0, n0))
    scored = scored.withColumn("z", F.col("odds") / F.sqrt(1 / (y1 + a) + 1 / (y0 + a))).withColumn("telling", (F.abs("z") >= Z_LEAST) & (F.abs("odds") >= ODDS_LEAST))
    best = scored.filter("telling").orderBy(F.abs("z").desc(), "token").limit(model_tokens).select("token", "z", "odds")
    weights = {r["token"]: (r["z"], r["odds"]) for r in best.collect()}
    # tokens met often enough that are neutral, where a less specific one is not
    letters = F.regexp_replace("token", "^=", "")
    shorter = F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), F.least(F.lit(8), F.length(letters)))), lambda k: F.substring(letters, F.lit(1), k))
    neutral = scored.filter((~F.col("telling")) & (y1 + y0 >= VOTES_SURE)).select("token", "toxic", "clean", F.explode(shorter).alias("part"))
    neutral = neutral.join(F.broadcast(best.select(F.col("token").alias("part"))), "part").select("token", (F.col("toxic") + F.col("clean")).alias("n")).distinct()
    for r in neutral.orderBy(F.col("n").desc(), "token").limit(model_tokens).collect():
        weights[r["token"]] = (0.0, 0.0)
    return weights


def scanned(rows: DataFrame, weights: dict) -> DataFrame:
    """Per document of the calibration part: toxic, n, segment scores, and the weights other than zero that its words have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(weights)
        for part, texts in steps(batches):
            found = [scanner.scan(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("toxic"), part.column("vote"), pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([own.round(6).tolist() for _, own, _ in found], pa.list_(pa.float64())), pa.array([[s for _, _, s in x] for _, _, x in found], pa.list_(pa.float64())),
                ],
                names=["toxic", "vote", "n", "weights", "segments"],
            )

    return rows.mapInArrow(run, "toxic boolean, vote long, n long, weights array<double>, segments array<double>")


def extreme_rate(values: np.ndarray, counts: np.ndarray, total: float) -> float:
    """The positive root of sum p * exp(rate * s) = 1 for the scores of clean words."""
    p, p0 = counts / total, max(0.0, 1 - counts.sum() / total)

    def over(rate: float) -> float:
        return float((p * np.exp(np.minimum(rate * (values - DRIFT), 500.0))).sum() + p0 * math.exp(-rate * DRIFT) - 1)

    low, high = 0.0, 1.0
    while over(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if over(mid) < 0 else (low, mid)
    return max(high, 1e-3)


def logistic(x: np.ndarray, y: np.ndarray, votes: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Intercept and slope (not negative), with one pseudo-vote of either class at no evidence."""
    x, y, votes = np.append(x, [0.0, 0.0]), np.append(y, [0.0, 1.0]), np.append(votes, [1.0, 0.05])
    z, w = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (votes * (y - p)) - ridge * w
        hessian = (z * (votes * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        move = np.linalg.solve(hessian, gradient)
        w = w + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return float(w[0]), max(0.0, float(w[1]))


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, train_rows: int = TRAIN_ROWS, model_tokens: int = MODEL_TOKENS) -> Model:
    """`learnable` is a condition on doc_id; what the driver gets is bounded by the two parameters."""
    rows = written(with_copy_key(training_rows(docs, labels, learnable, train_rows)), "toxic_train")
    copies = rows.groupBy("copy_key", "toxic", "calibrates").agg(F.count("*").alias("copies"))
    voting = rows.join(copies, ["copy_key", "toxic", "calibrates"]).withColumn("vote", F.floor(F.lit(VOTE) / F.col("copies")).cast("long"))
    weights = fit_weights(written(token_votes(voting.filter(~F.col("calibrates"))), "toxic_votes"), model_tokens)
    part = written(scanned(voting.filter("calibrates"), weights), "toxic_scan")
    clean = part.filter(~F.col("toxic"))
    words = clean.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.size("segments")), F.lit(0)).alias("s")).first()
    met = Counter({r["w"]: r["n"] for r in clean.select(F.explode("weights").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()})
    for _, odds in weights.values():
        if odds > 0:
            met[round(odds, 6)] += 1 / len(weights)
    values, counts = np.array(list(met.keys()) or [0.0]), np.array(list(met.values()) or [0.0])
    rate = extreme_rate(values, counts, words["n"] + counts.sum() + 1.0)
    least = min((o for _, o in weights.values() if o > 0), default=1.0) - DRIFT
    log_k = math.log((words["s"] + 0.5) / (words["n"] + 1.0)) + rate * least
    seen = part.select("toxic", "vote", "n", "segments").toPandas()
    x = np.array([strength(evidence(n, [(0, 0, s) for s in own], rate, log_k)) for n, own in zip(seen["n"], seen["segments"], strict=True)], dtype=np.float64)
    intercept, slope = logistic(x, seen["toxic"].to_numpy(dtype=np.float64), seen["vote"].to_numpy(dtype=np.float64) / VOTE)
    return Model(weights, rate, log_k, intercept, slope)


def strength(parts: list[float]) -> float:
    """The evidence of a document: the sum over its significant passages, damped."""
    return math.log1p(sum(e for e in parts if e > 0))


def score_documents(docs: DataFrame, model: Model, *, text: str = "text", reject: float = REJECT) -> DataFrame:
    """`docs` with score, predicted and passages (words start to end, end exclusive, with their evidence)."""
    results = ("score", "predicted", "passages")
    kept = [c for c in docs.columns if c not in results or c == text]
    passage = T.StructType().add("start", T.LongType()).add("end", T.LongType()).add("score", T.DoubleType())
    schema = T.StructType([docs.schema[c] for c in kept]).add("score", T.DoubleType()).add("predicted", T.IntegerType()).add("passages", T.ArrayType(passage))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model.weights)
        for part, texts in steps(batches, text):
            scores, passages = [], []
            for t in texts:
                n, _, segments = scanner.scan(t)
                parts = evidence(n, segments, model.rate, model.log_k)
                scores.append(1 / (1 + math.exp(-max(-700.0, min(700.0, model.intercept + model.slope * strength(parts))))))
                passages.append([{"start": a, "end": b + 1, "score": e} for (a, b, _), e in zip(segments, parts, strict=True) if e > 0])
            columns = [*(part.column(c) for c in kept), pa.array(scores, pa.float64()), pa.array([int(s >= reject) for s in scores], pa.int32()), pa.array(passages, _SEGMENTS)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*kept).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_learned(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its score, learned from labels outside the held-out third."""
    model = fit(docs, labels, ~held_out())
    return score_documents(docs, model)


