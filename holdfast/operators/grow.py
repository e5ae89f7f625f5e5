"""Forests and boosted trees grown from histograms, as models of MLlib.

MLlib grows one level of a tree per job or two, and each walks over rows as objects; a boosted model of 300 rounds is some two
thousand jobs.  Here one job (:mod:`gang`) grows all trees.  A row is held as the bins of its features, one byte for as many
features as fit together, and per level each task adds up, by node and bin, weights, weighted targets and rows; these sums are
added over the tasks, and all of them choose the same splits.  Trees are what MLlib grows: its impurities, gains, least gains and
least rows of a node, its rounds on pseudo-residuals, at most `maxBins` bins.  The model is loaded from MLlib's own format.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import key_text
from ..functions.text import ref
from ..session import scratch_path
from . import gang

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Values of a feature that a summary keeps, each standing for those up to it; fewer distinct values are kept as they are.
SUMMARY = 1024
#: Rows that a summary or a histogram takes at a time.
STEP = 1 << 16

_NODES = (
    "treeID int, id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, leftChild int, rightChild int, "
    "featureIndex int, cut double"
)


def inputs(rows: DataFrame, features: Sequence[str], key: str, weight: str | None, label: str) -> DataFrame:
    """(id, y, w, f0, f1 ...): what a fit reads.  Rows without the key get an id by their values and place."""
    made = F.xxhash64(key_text(key)) if key in rows.columns else F.xxhash64(*[ref(f) for f in features], F.monotonically_increasing_id())
    w = ref(weight).cast("double") if weight else F.lit(1.0)
    return rows.select(made.alias("id"), ref(label).cast("double").alias("y"), w.alias("w"), *[ref(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])


def numbers(column) -> np.ndarray:
    """A column as numbers; missing ones are an error, as in MLlib's assembler."""
    x = column.to_numpy(zero_copy_only=False)
    if column.null_count or (x.dtype.kind == "f" and np.isnan(x).any()):
        raise ValueError("a null or NaN among the features, labels or weights of a fit")
    return x


def compressed(values: np.ndarray, counts: np.ndarray, size: int = SUMMARY) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted values with their counts; of more than `size`, those that end equal shares of the rows."""
    order = np.argsort(values, kind="stable")
    values, starts = np.unique(values[order], return_index=True)
    counts = np.add.reduceat(counts[order], starts) if len(starts) else counts
    if len(values) <= size:
        return values, counts
    upto = np.cumsum(counts)
    kept = np.unique(np.searchsorted(upto, upto[-1] * (np.arange(1, size + 1) / size)).clip(max=len(values) - 1))
    return values[kept], np.diff(upto[kept], prepend=0)


def cuts_of(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between values: all of them if there are few enough, else those nearest to equal shares of the rows."""
    between = (values[:-1] + values[1:]) / 2
    if len(between) < bins:
        return between
    upto, targets = np.cumsum(counts), counts.sum() / bins * np.arange(1, bins)
    at = np.searchsorted(upto, targets).clip(1, len(upto) - 1)
    at -= np.abs(upto[at - 1] - targets) <= np.abs(upto[at] - targets)
    return between[np.unique(at.clip(max=len(between) - 1))]


def summaries(held: DataFrame, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(values, counts) of the label, the weight and each feature, from all rows.  A task merges the summaries of its rows."""
    names = ["y", "w", *[f"f{i}" for i in range(n)]]

    def own(batches):
        import pyarrow as pa

        found: list[list] = [[] for _ in names]
        waiting, rows = [], 0

        def take():
            for i, name in enumerate(names):
                x = np.concatenate([numbers(b.column(name)) for b in waiting])
                found[i].append(compressed(x, np.ones(len(x))))

        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= 8 * STEP:
                take()
                waiting, rows = [], 0
        if rows:
            take()
        for i, parts in enumerate(found):
            if parts:
                values, counts = compressed(np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts]))
                yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int64()), "v": [values], "c": [counts]})

    def merged(parts):
        import pyarrow as pa

        whole = lambda name: parts.column(name).combine_chunks().flatten().to_numpy()
        values, counts = compressed(whole("v"), whole("c"), 4 * SUMMARY)
        return pa.table({"i": parts.column("i").slice(0, 1), "v": pa.array([values]), "c": pa.array([counts])})

    schema = "i bigint, v array<double>, c array<double>"
    got = {r["i"]: (np.array(r["v"]), np.array(r["c"])) for r in held.mapInArrow(own, schema).groupBy("i").applyInArrow(merged, schema).collect()}
    return [got.get(i, (np.empty(0), np.empty(0))) for i in range(len(names))]


def packed(bins: Sequence[int]) -> list[list[int]]:
    """Features that share a byte: as long as the product of their bins is at most 256, largest first."""
    groups: list[tuple[int, list[int]]] = []
    for f in sorted(range(len(bins)), key=lambda f: -bins[f]):
        at = next((i for i, (size, _) in enumerate(groups) if size * bins[f] <= 256), None)
        if at is None:
            groups.append((bins[f], [f]))
        else:
            groups[at] = (groups[at][0] * bins[f], [*groups[at][1], f])
    return [g for _, g in groups]


def subset_size(strategy: str, n: int, forest: bool) -> int:
    """Features that a node may choose from, by MLlib's names of strategies."""
    if strategy == "auto":
        strategy = "sqrt" if forest else "all"
    named = {"all": n, "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n))), "onethird": math.ceil(n / 3)}
    if strategy in named:
        return min(n, named[strategy])
    return min(n, int(strategy)) if strategy.isdigit() else max(1, math.ceil(float(strategy) * n))


def mixed(ids: np.ndarray, seed: int) -> np.ndarray:
    """A uniform 64-bit number per id and seed (splitmix64)."""
    z = ids + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Rows:
    """The rows of a task: packed bins by column, label, weight and id, in the order of the ids."""

    def __init__(self, batches, cuts: Sequence[np.ndarray]):
        self.cuts, self.bins = cuts, [len(c) + 1 for c in cuts]
        self.groups = packed(self.bins)
        self.sizes = [math.prod(self.bins[f] for f in g) for g in self.groups]
        # a feature's column, the product of the bins before it in there
        self.column, self.stride = np.zeros(len(cuts), dtype=np.int64), np.ones(len(cuts), dtype=np.int64)
        for c, g in enumerate(self.groups):
            step = 1
            for f in g:
                self.column[f], self.stride[f] = c, step
                step *= self.bins[f]
        codes, ids, y, w = [np.empty((len(self.groups), 0), np.uint8)], [np.empty(0, np.uint64)], [np.empty(0, np.float32)], [np.empty(0)]
        for batch in batches:
            code = np.zeros((len(self.groups), batch.num_rows), dtype=np.uint8)
            for f, cut in enumerate(cuts):
                code[self.column[f]] += (np.searchsorted(cut, numbers(batch.column(f"f{f}"))) * self.stride[f]).astype(np.uint8)
            codes.append(code)
            ids.append(batch.column("id").to_numpy().view(np.uint64))
            y.append(numbers(batch.column("y")).astype(np.float32))
            w.append(numbers(batch.column("w")))
        self.ids = np.concatenate(ids)
        order = np.argsort(self.ids, kind="stable")
        self.ids, self.codes = self.ids[order], np.ascontiguousarray(np.concatenate(codes, axis=1)[:, order])
        self.y, self.w = np.concatenate(y)[order], np.concatenate(w)[order]
        self.n = len(self.ids)


def _histogram(rows: Rows, node: np.ndarray, slot_of: np.ndarray, active: int, sums: Sequence[np.ndarray]) -> np.ndarray:
    """(sums, active nodes, bins of all features): totals by node and bin."""
    size = active + 1
    held = [np.zeros((len(sums), size * k)) for k in rows.sizes]
    step = max(STEP, 512 * size)
    for a in range(0, rows.n, step):
        part = slice(a, a + step)
        slot = slot_of[node[part]]
        for c, k in enumerate(rows.sizes):
            at = slot * k + rows.codes[c, part]
            for i, s in enumerate(sums):
                held[c][i] += np.bincount(at, s[part], minlength=size * k)
    out = [np.empty(0)] * len(rows.bins)
    for c, g in enumerate(rows.groups):
        # the last feature of a column changes slowest
        shape = held[c].reshape(len(sums), size, *[rows.bins[f] for f in reversed(g)])[:, :active]
        for place, f in enumerate(reversed(g)):
            out[f] = shape.sum(axis=tuple(2 + i for i in range(len(g)) if i != place))
    return np.concatenate(out, axis=2)


def _tree(rows: Rows, peers: gang.Peers, sums: list[np.ndarray], square: np.ndarray | None, spec: dict, number: int) -> tuple[dict, np.ndarray]:
    """One tree on rows with sums (weight, weight x target, rows), and the node that each row ends in.

    `square` (weight x target squared) is given for variance; without it the target is a class and the impurity Gini.
    """
    n, bins = len(rows.bins), np.array(rows.bins)
    widest = int(bins.max())
    first = np.concatenate([[0], np.cumsum(bins)[:-1]])
    # place of (feature, bin) in the row of a histogram; one beyond it where a feature has no such bin
    place = np.where(np.arange(widest) < bins[:, None], first[:, None] + np.arange(widest), bins.sum())
    chosen = subset_size(spec["subset"], n, square is None)
    t = {k: [v] for k, v in (("left", -1), ("right", -1), ("feature", -1), ("cut", 0.0), ("gain", -1.0), ("stats", None))}
    node = np.zeros(rows.n, dtype=np.int32)
    active = [0]
    for depth in range(spec["depth"]):
        slot_of = np.full(len(t["left"]), len(active))
        slot_of[active] = np.arange(len(active))
        flat = peers.total(_histogram(rows, node, slot_of, len(active), sums))
        if len(flat) == 2:
            # all weights are one: the rows are the weights
            flat = np.concatenate([flat, flat[:1]])
        h = np.concatenate([flat, np.zeros((3, len(active), 1))], axis=2)[:, :, place]
        whole = h[:, :, 0].sum(axis=2)
        left = h.cumsum(axis=3)[..., :-1]
        right = whole[:, :, None, None] - left
        if depth == 0:
            t["stats"][0] = whole[:, 0]

        def spread(x):
            with np.errstate(divide="ignore", invalid="ignore"):
                return x[1] ** 2 / x[0] + (0.0 if square is not None else (x[0] - x[1]) ** 2 / x[0])

        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (spread(left) + spread(right) - spread(whole)[:, None, None]) / whole[0][:, None, None]
        few = (left[2] < spec["min_rows"]) | (right[2] < spec["min_rows"]) | (left[0] <= 0) | (right[0] <= 0)
        gain = np.where(few | (np.arange(widest - 1) >= (bins - 1)[:, None]) | ~np.isfinite(gain), -np.inf, gain)
        if chosen < n:
            draw = np.random.default_rng([spec["seed"] & 0xFFFFFFFF, number, depth]).random((len(active), n))
            gain = np.where((draw.argsort(axis=1).argsort(axis=1) < chosen)[:, :, None], gain, -np.inf)
        gain = gain.reshape(len(active), -1)
        best = gain.argmax(axis=1) if gain.shape[1] else np.zeros(len(active), dtype=np.int64)
        following, child = [], np.full((len(active) + 1, 256), -1, dtype=np.int32)
        column = np.zeros(len(active) + 1, dtype=np.int64)
        for slot, at in enumerate(active):
            found = gain[slot, best[slot]] if gain.shape[1] else -np.inf
            if not (found > 1e-15 and found >= spec["min_gain"]):
                continue
            f, b = divmod(int(best[slot]), widest - 1)
            new = len(t["left"])
            t["left"][at], t["right"][at], t["feature"][at], t["cut"][at], t["gain"][at] = new, new + 1, f, float(rows.cuts[f][b]), float(found)
            for side in (left, right):
                for k, v in (("left", -1), ("right", -1), ("feature", -1), ("cut", 0.0), ("gain", -1.0), ("stats", side[:, slot, f, b])):
                    t[k].append(v)
            column[slot] = rows.column[f]
            child[slot] = np.where((np.arange(256) // rows.stride[f]) % rows.bins[f] <= b, new, new + 1)
            following += [x for x in (new, new + 1) if t["stats"][x][2] >= 2 * spec["min_rows"]]
        if len(t["left"]) > len(slot_of):
            codes, table = rows.codes.reshape(-1), child.reshape(-1)
            for a in range(0, rows.n, STEP):
                part = slice(a, min(a + STEP, rows.n))
                slot = slot_of[node[part]]
                code = codes[column[slot] * rows.n + np.arange(part.start, part.stop)]
                to = table[slot * 256 + code]
                node[part] = np.where(to >= 0, to, node[part])
        active = following
        if not active:
            break
    if spec["depth"] == 0:
        t["stats"][0] = np.resize(peers.total(np.array([s.sum() for s in sums])), 3)
    stats = np.array(t["stats"])
    if square is not None:
        own = np.zeros(len(stats))
        for a in range(0, rows.n, STEP):
            own += np.bincount(node[a : a + STEP], square[a : a + STEP], minlength=len(stats))
        own = peers.total(own)
        for at in reversed(range(len(stats))):
            if t["left"][at] >= 0:
                own[at] = own[t["left"][at]] + own[t["right"][at]]
        stats = np.column_stack([stats, own])
    return t | {"stats": stats}, node


def _numbered(t: dict, number: int, forest: bool) -> dict:
    """The nodes of a tree as columns; two leaves of one prediction become one, as in MLlib."""
    stats = t["stats"]
    w = np.maximum(stats[:, 0], 1e-300)
    if forest:
        kept = np.column_stack([stats[:, 0] - stats[:, 1], stats[:, 1]])
        prediction, impurity = (kept[:, 1] > kept[:, 0]).astype(float), 1 - (kept**2).sum(axis=1) / w**2
    else:
        kept, prediction = stats[:, [0, 1, 3]], stats[:, 1] / w
        impurity = np.maximum(stats[:, 3] / w - prediction**2, 0.0)
    left, right = list(t["left"]), list(t["right"])
    for at in reversed(range(len(left))):
        a, b = left[at], right[at]
        if a >= 0 and left[a] < 0 and left[b] < 0 and prediction[a] == prediction[b]:
            left[at] = right[at] = -1
    seen, order = {0: 0}, [0]
    for at in order:
        if left[at] >= 0:
            for x in (left[at], right[at]):
                seen[x] = len(order)
                order.append(x)
    leaf = lambda at: left[at] < 0
    return {
        "treeID": [number] * len(order),
        "id": list(range(len(order))),
        "prediction": prediction[order],
        "impurity": impurity[order],
        "impurityStats": list(kept[order]),
        "rawCount": [round(float(c)) for c in stats[order, 2]],
        "gain": [-1.0 if leaf(at) else t["gain"][at] for at in order],
        "leftChild": [-1 if leaf(at) else seen[left[at]] for at in order],
        "rightChild": [-1 if leaf(at) else seen[right[at]] for at in order],
        "featureIndex": [-1 if leaf(at) else t["feature"][at] for at in order],
        "cut": [t["cut"][at] for at in order],
    }


def _grower(spec: dict, cuts: Sequence[np.ndarray]):
    """The work of one task: trees after trees, each yielded when it is grown."""

    def work(batches, peers):
        import pyarrow as pa

        rows = Rows(batches, cuts)
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
        names = [c.split()[0] for c in _NODES.split(", ")]
        limit = np.uint64(min(2**64 - 1, int(spec["share"] * 2.0**64)))
        poisson = np.cumsum([math.exp(-spec["share"]) * spec["share"] ** k / math.factorial(k) for k in range(20)])
        margin = np.zeros(rows.n)
        for number in range(spec["trees"]):
            bag, target = np.empty(rows.n), rows.y.astype(np.float64)
            for a in range(0, rows.n, STEP):
                part = slice(a, a + STEP)
                draw = mixed(rows.ids[part], spec["seed"] + number)
                if spec["forest"]:
                    bag[part] = np.searchsorted(poisson, (draw >> np.uint64(11)) / 2.0**53, side="right")
                    continue
                bag[part] = draw < limit if spec["share"] < 1 else 1.0
                sign = 2 * target[part] - 1
                target[part] = 4 * sign / (1 + np.exp(np.minimum(2 * sign * margin[part], 700.0))) if number else sign
            weight = bag * rows.w if spec["weighted"] else bag
            sums = [weight, weight * target, *([bag] if spec["weighted"] else [])]
            t, node = _tree(rows, peers, sums, None if spec["forest"] else weight * target**2, spec, number)
            if not spec["forest"]:
                value = t["stats"][:, 1] / np.maximum(t["stats"][:, 0], 1e-300)
                margin += (spec["rate"] if number else 1.0) * value[node]
            if peers.rank == 0:
                columns = _numbered(t, number, spec["forest"])
                yield pa.RecordBatch.from_arrays([pa.array(columns[c], k) for c, k in zip(names, kinds)], names=names)

    return work


def takes(estimator: Estimator) -> bool:
    """Whether this module grows what the estimator asks for; MLlib's own fit does the rest."""
    if isinstance(estimator, RandomForestClassifier):
        plain = estimator.getImpurity() == "gini" and estimator.getBootstrap()
    elif isinstance(estimator, GBTClassifier):
        plain = not estimator.isDefined(estimator.validationIndicatorCol)
    else:
        return False
    return plain and estimator.getMinWeightFractionPerNode() == 0 and estimator.getMaxBins() <= 256


def fit(estimator: Estimator, rows: DataFrame, features: Sequence[str], key: str, weight: str | None, label: str) -> Model | None:
    """The model that the estimator asks for; None where MLlib's own fit has to do it: features that are vectors, labels
    beyond 0 and 1, no rows, or a cluster that cannot run tasks side by side."""
    if not takes(estimator) or not features or any(rows.schema[f].dataType.typeName() == "vectorudt" for f in features):
        return None
    forest, n = isinstance(estimator, RandomForestClassifier), len(features)
    held = inputs(rows, features, key, weight, label)
    (labels, counts), (weights, _), *found = summaries(held, n)
    if not len(labels) or not set(labels.tolist()) <= {0.0, 1.0}:
        return None
    size = gang.tasks(rows.sparkSession, int(counts.sum()))
    if size is None:
        return None
    spec = {
        "forest": forest,
        "trees": estimator.getNumTrees() if forest else estimator.getMaxIter(),
        "depth": estimator.getMaxDepth(),
        "min_rows": estimator.getMinInstancesPerNode(),
        "min_gain": estimator.getMinInfoGain(),
        "subset": estimator.getFeatureSubsetStrategy(),
        "share": estimator.getSubsamplingRate(),
        "seed": estimator.getSeed(),
        "rate": 1.0 if forest else estimator.getStepSize(),
        "weighted": weights.tolist() != [1.0],
    }
    cuts = [cuts_of(v, c, estimator.getMaxBins()) for v, c in found]
    grown = gang.run(held, "id", size, _grower(spec, cuts), _NODES)
    return _loaded(estimator, grown, spec, n)


def _loaded(estimator: Estimator, grown: DataFrame, spec: dict, n: int) -> Model:
    """Writes the trees the way MLlib saves models, and loads them."""
    spark, path = grown.sparkSession, scratch_path(grown.sparkSession, "grown")
    leaf = F.col("leftChild") < 0
    threshold = F.when(leaf, F.array().cast("array<double>")).otherwise(F.array("cut"))
    split = F.struct("featureIndex", threshold.alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    plain = ("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild")
    grown.select("treeID", F.struct(*plain, split.alias("split")).alias("nodeData")).write.parquet(f"{path}/data")
    estimator.write().save(f"{path}-estimator")
    about = json.loads(spark.read.text(f"{path}-estimator/metadata").first()[0])
    kind = GBTClassificationModel if not spec["forest"] else RandomForestClassificationModel
    own = {"numFeatures": n, "numTrees": spec["trees"], **({"numClasses": 2} if spec["forest"] else {})}
    whole = about | {"class": f"org.apache.spark.ml.classification.{kind.__name__}"} | own
    shared = {"cacheNodeIds", "checkpointInterval", "featuresCol", "impurity", "labelCol", "leafCol", "maxBins", "maxDepth", "maxMemoryInMB", "minInfoGain"}
    shared |= {"minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "seed", *({"probabilityCol", "rawPredictionCol"} if spec["forest"] else ())}
    single = about | {"class": "org.apache.spark.ml." + ("classification.DecisionTreeClassificationModel" if spec["forest"] else "regression.DecisionTreeRegressionModel")}
    single |= {m: {k: v for k, v in about[m].items() if k in shared} for m in ("paramMap", "defaultParamMap")}
    trees = [(i, json.dumps(single | {"uid": f"{about['uid']}_{i}"}), 1.0 if spec["forest"] or not i else spec["rate"]) for i in range(spec["trees"])]
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return kind.load(path)
