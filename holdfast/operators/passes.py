"""Fits that are passes over rows between small steps, each as one job (:mod:`gang`): the network and the clustering.

MLlib runs a job per pass, on objects or one row after the other.  Here tasks keep their rows as matrices, compute a pass in
blocks, and add up what has the size of the model.  Models are loaded from MLlib's own format.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.ml import Model
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ref
from ..session import scratch_path
from . import gang, grow

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(grow)

#: Rows that a step of a pass takes.
BLOCK = 1 << 13


def _matrix(batches, columns: Sequence[str], dtype) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of a task's rows, in the order of the ids."""
    ids, parts = [np.empty(0, np.int64)], [np.empty((0, len(columns)), dtype)]
    for batch in batches:
        ids.append(batch.column("id").to_numpy())
        parts.append(np.column_stack([grow.numbers(batch.column(c)) for c in columns]).astype(dtype))
    found, x = np.concatenate(ids), np.concatenate(parts)
    order = np.argsort(found, kind="stable")
    return found[order], x[order]


def minimised(ask, x: np.ndarray, steps: int, tolerance: float, memory: int = 10) -> np.ndarray:
    """L-BFGS with a search for the strong Wolfe conditions; `ask` gives value and gradient."""
    f, g = ask(x)
    history, values = [], [f]
    for step in range(steps):
        d = -g
        kept = []
        for s, y, rho in reversed(history):
            a = rho * (s @ d)
            kept.append(a)
            d = d - a * y
        if history:
            s, y, rho = history[-1]
            d = d / (rho * (y @ y))
        for (s, y, rho), a in zip(history, reversed(kept)):
            d = d + (a - rho * (y @ d)) * s
        if not (d @ g < 0):
            history, d = [], -g
        found = _searched(ask, x, f, g, d, 1.0 if history else 1.0 / max(1e-300, np.sqrt(g @ g)))
        if found is None:
            if not history:
                break
            history = []
            continue
        new, value, gradient = found
        s, y = new - x, gradient - g
        if s @ y > 1e-300:
            history = [*history, (s, y, 1.0 / (s @ y))][-memory:]
        x, f, g = new, value, gradient
        values = [*values, f][-20:]
        if np.sqrt(g @ g) <= tolerance * max(abs(f), 1e-8) or (len(values) == 20 and max(values) - f <= tolerance * max(abs(f), 1e-8)):
            break
    return x


def _searched(ask, x, f, g, d, t):
    """A point along `d` where the value fell enough and the slope is flatter; None if there is none."""
    slope, low, high, best = g @ d, 0.0, np.inf, None
    for _ in range(20):
        value, gradient = ask(x + t * d)
        if not np.isfinite(value) or value > f + 1e-4 * t * slope:
            high = t
        else:
            best = (x + t * d, value, gradient)
            here = gradient @ d
            if abs(here) <= 0.9 * abs(slope):
                return best
            if here < 0:
                low = t
            else:
                high = t
        t = 2 * t if high == np.inf else (low + high) / 2
    return best


def network(estimator: MultilayerPerceptronClassifier, rows: DataFrame, features: Sequence[str], key: str, label: str) -> Model | None:
    """The network that the estimator asks for: sigmoids, a softmax at the end, log-loss by L-BFGS.  None where MLlib's own fit
    has to do it."""
    plain = isinstance(estimator, MultilayerPerceptronClassifier) and estimator.getSolver() == "l-bfgs" and not estimator.isDefined(estimator.initialWeights)
    layers = list(estimator.getLayers()) if plain else []
    if not plain or layers[0] != len(features) or any(rows.schema[f].dataType.typeName() == "vectorudt" for f in features):
        return None
    held = grow.inputs(rows, features, key, None, label)
    kinds = {r["y"]: r["n"] for r in held.groupBy("y").agg(F.count("*").alias("n")).limit(layers[-1] + 1).collect()}
    size = gang.tasks(rows.sparkSession, sum(kinds.values())) if kinds and set(kinds) <= set(map(float, range(layers[-1]))) else None
    if size is None:
        return None
    seed, steps, tolerance, n = estimator.getSeed(), estimator.getMaxIter(), estimator.getTol(), sum(kinds.values())
    spots = np.cumsum([0, *[a * b + b for a, b in zip(layers, layers[1:])]])

    def work(batches, peers):
        import pyarrow as pa

        _, x = _matrix(batches, ["y", *[f"f{i}" for i in range(len(features))]], np.float32)
        y, x = x[:, 0].astype(np.int64), np.ascontiguousarray(x[:, 1:])

        def parts(w):
            # MLlib's order: a layer's matrix by input, then its intercepts
            return [(w[p : p + a * b].reshape(a, b), w[p + a * b : p + a * b + b]) for p, a, b in zip(spots, layers, layers[1:])]

        def ask(w):
            held = parts(w.astype(np.float32))
            total = np.zeros(1 + len(w))
            sums = parts(total[1:])
            for first in range(0, len(x), BLOCK):
                out, target = [x[first : first + BLOCK]], y[first : first + BLOCK]
                for i, (m, b) in enumerate(held):
                    z = out[-1] @ m + b
                    out.append(z if i == len(held) - 1 else 1 / (1 + np.exp(-z.clip(-80, 80))))
                z = out[-1] - out[-1].max(axis=1, keepdims=True)
                e = np.exp(z)
                mass = e.sum(axis=1, keepdims=True)
                at = np.arange(len(target))
                total[0] += (np.log(mass[:, 0]) - z[at, target]).sum(dtype=np.float64)
                delta = e / mass
                delta[at, target] -= 1
                for i in reversed(range(len(held))):
                    sums[i][0][:] += out[i].T @ delta
                    sums[i][1][:] += delta.sum(axis=0)
                    if i:
                        delta = (delta @ held[i][0].T) * out[i] * (1 - out[i])
            total = peers.total(total) / n
            return total[0], total[1:]

        draw = np.random.default_rng(seed & 0xFFFFFFFF)
        start = np.concatenate([draw.uniform(-2.4, 2.4, a * b + b) / a for a, b in zip(layers, layers[1:])])
        yield pa.RecordBatch.from_pydict({"weights": [minimised(ask, start, steps, tolerance)]})

    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "network")
    gang.run(held, "id", size, work, "weights array<double>").select(array_to_vector("weights").alias("weights")).write.parquet(f"{path}/data")
    return _loaded(spark, path, estimator, MultilayerPerceptronClassificationModel)


def clusterings(estimator: KMeans, rows: DataFrame, features: Sequence[str], restarts: int) -> tuple[KMeansModel, float] | None:
    """(the best of several starts, its cost): starts seeded `estimator.getSeed()` and after, in one job.

    Centres start at rows drawn with the square of their distance from those before; passes go on until no centre moves further
    than the tolerance.  None without rows, or on a cluster that cannot run tasks side by side.
    """
    names = [f"f{i}" for i in range(len(features))]
    held = rows.select(F.xxhash64(*[ref(f) for f in features], F.monotonically_increasing_id()).alias("id"), *[ref(f).cast("double").alias(n) for f, n in zip(features, names)])
    n = rows.count()
    size = gang.tasks(rows.sparkSession, n) if n else None
    if size is None:
        return None
    k, seed, steps, tolerance = estimator.getK(), estimator.getSeed(), estimator.getMaxIter(), estimator.getTol()

    def work(batches, peers):
        import pyarrow as pa

        ids, x = _matrix(batches, names, np.float64)
        ids, dims = ids.view(np.uint64), x.shape[1]

        def drawn(by, number):
            """The row of all tasks that comes first in a race in which a row runs at the speed `by`; None if none does."""
            best, point = np.inf, np.zeros(dims)
            for a in range(0, len(x), 8 * BLOCK):
                part = slice(a, a + 8 * BLOCK)
                u = ((grow.mixed(ids[part], number) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
                with np.errstate(divide="ignore"):
                    time = -np.log(u) / by[part]
                i = int(time.argmin())
                if time[i] < best:
                    best, point = time[i], x[a + i]
            said = np.zeros((peers.size, 2 + dims))
            if np.isfinite(best):
                said[peers.rank] = [1.0, best, *point]
            said = peers.total(said)
            said = said[said[:, 0] > 0]
            return said[said[:, 1].argmin(), 2:] if len(said) else None

        def gaps(part, centres):
            return sum((part[:, [j]] - centres[:, j]) ** 2 for j in range(dims))

        def passed(centres):
            """Per centre its rows and the sums of their values; then the cost."""
            sums, cost = np.zeros((len(centres), 1 + dims)), 0.0
            for a in range(0, len(x), BLOCK):
                part = x[a : a + BLOCK]
                far = gaps(part, centres)
                own = far.argmin(axis=1)
                cost += far[np.arange(len(own)), own].sum()
                sums[:, 0] += np.bincount(own, minlength=len(centres))
                for j in range(dims):
                    sums[:, 1 + j] += np.bincount(own, part[:, j], minlength=len(centres))
            told = peers.total(np.append(sums.reshape(-1), cost))
            return told[:-1].reshape(sums.shape), told[-1]

        best, found = None, np.inf
        for start in range(restarts):
            centres = drawn(np.ones(len(x)), (seed + start) * 1000)[None]
            near = np.full(len(x), np.inf)
            while len(centres) < k:
                for a in range(0, len(x), 8 * BLOCK):
                    part = slice(a, a + 8 * BLOCK)
                    near[part] = np.minimum(near[part], gaps(x[part], centres[-1:])[:, 0])
                new = drawn(near, (seed + start) * 1000 + len(centres))
                if new is None:
                    break
                centres = np.vstack([centres, new])
            for _ in range(steps):
                sums, _ = passed(centres)
                moved = np.where(sums[:, :1] > 0, sums[:, 1:] / np.maximum(sums[:, :1], 1), centres)
                still = ((moved - centres) ** 2).sum(axis=1).max() <= tolerance**2
                centres = moved
                if still:
                    break
            cost = passed(centres)[1]
            if cost < found:
                best, found = centres, cost
        yield pa.RecordBatch.from_pydict({"centres": [best.tolist()], "cost": [found]})

    got = gang.run(held, "id", size, work, "centres array<array<double>>, cost double").collect()[0]
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "clustering")
    table = spark.createDataFrame(list(enumerate(got["centres"])), "clusterIdx int, centre array<double>")
    table.select("clusterIdx", array_to_vector("centre").alias("clusterCenter")).coalesce(1).write.parquet(f"{path}/data")
    return _loaded(spark, path, estimator, KMeansModel), got["cost"]


def _loaded(spark, path: str, estimator, kind):
    """The model of a class whose data lie at `path`."""
    estimator.write().save(f"{path}-estimator")
    about = json.loads(spark.read.text(f"{path}-estimator/metadata").first()[0])
    about["class"] = about["class"].rsplit(".", 1)[0] + f".{kind.__name__}"
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return kind.load(path)
