"""Per-row attributions, their ranking and the actions they suggest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ref

PAIRS = "array<struct<feature: string, value: double>>"


def as_pairs(columns: Mapping[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(f).alias("feature"), c.cast("double").alias("value")) for f, c in columns.items()])


def attribution_linear(df: DataFrame, coefficients: Mapping[str, float], means: Mapping[str, float], keep: Sequence[str] = ()) -> DataFrame:
    """coefficient * (x - mean) per feature, as an array of (feature, value): no shuffle, no row multiplication."""
    parts = {f: F.lit(float(c)) * (ref(f).cast("double") - F.lit(float(means.get(f, 0.0)))) for f, c in coefficients.items()}
    return df.select(*[ref(k) for k in keep], as_pairs(parts).alias("attribution"))


def linear_terms(model: PipelineModel, features: Sequence[str]) -> dict[str, float]:
    return dict(zip(features, (float(c) for c in model.stages[-1].coefficients)))


def to_long(df: DataFrame, keep: Sequence[str], column: str = "attribution") -> DataFrame:
    return df.select(*[ref(k) for k in keep], F.explode(column).alias("__a")).select(*[ref(k) for k in keep], "__a.feature", "__a.value")


def _by_size(pairs: Column) -> Column:
    """Largest absolute value first, then by name.  Struct order does it, without a comparator per pair."""
    keyed = F.transform(pairs, lambda p: F.struct((-F.abs(p["value"])).alias("size"), p["feature"].alias("feature"), p["value"].alias("value")))
    return F.transform(F.sort_array(keyed), lambda p: F.struct(p["feature"].alias("feature"), p["value"].alias("value")))


def topk_attribution(df: DataFrame, top: int = 8, each: int = 5, column: str = "attribution") -> DataFrame:
    """Adds the strongest features, and the strongest of either sign, as ordered arrays.

    A row's attributions are ranked inside the row, so ranking needs no shuffle at any table size.
    """
    ordered = _by_size(F.filter(ref(column), lambda p: p["value"].isNotNull()))
    return (
        df.withColumn("__o", ordered)
        .withColumn("top_features", F.slice("__o", 1, top))
        .withColumn("risk_increasers", F.slice(F.filter("__o", lambda p: p["value"] > 0), 1, each))
        .withColumn("risk_decreasers", F.slice(F.filter("__o", lambda p: p["value"] < 0), 1, each))
        .drop("__o")
    )


# Feature name patterns in order of precedence, with the action each one suggests.
# Only the second ignores case.
CHURN_PATTERNS: tuple[tuple[tuple[str, ...], bool, str], ...] = (
    (("Contract",), False, "CONTRACT_UPGRADE"),
    (("tenure",), True, "ONBOARDING"),
    (("MonthlyCharges",), False, "BILL_BUNDLE"),
    (("Fiber",), False, "FIBER_QUALITY"),
    (("Electronic check",), False, "AUTO_PAYMENT"),
    (("Products",), False, "PRODUCT_REVIEW"),
    (("Age",), False, "RELATIONSHIP_MANAGER"),
    (("Active",), False, "REENGAGE"),
    (("Balance",), False, "BALANCE_INCENTIVE"),
    (("Geography",), False, "REGIONAL_LOYALTY"),
    (("Complain",), False, "RESOLVE_COMPLAINT"),
    (("Satisfaction",), False, "APOLOGY_VOUCHER"),
    (("DaySinceLastOrder",), False, "PRODUCT_TIPS"),
    (("CashbackAmount",), False, "MORE_CASHBACK"),
    (("Hour",), False, "PUSH_OFFER"),
    (("WarehouseToHome",), False, "FREE_SHIPPING"),
)
STAY_PATTERNS: tuple[tuple[str, str, bool], ...] = (
    ("Contract", "LOYALTY_BENEFIT", False),
    ("tenure", "LOYALTY_BENEFIT", True),
    ("Active", "VIP_PROGRAMME", False),
    ("Satisfaction", "ASK_REFERRAL", False),
)


def churn_action(feature: str) -> str | None:
    for needles, any_case, action in CHURN_PATTERNS:
        text = feature.lower() if any_case else feature
        if any(n in text for n in needles):
            return action
    return None


def stay_action(feature: str) -> str | None:
    for needle, action, any_case in STAY_PATTERNS:
        if needle in (feature.lower() if any_case else feature):
            return action
    return None


def _actions_for(features: Sequence[str], rule) -> Column:
    """The feature contract is fixed, so patterns are matched once per name and become a literal map."""
    known = {f: rule(f) for f in features}
    hits = [x for f, a in known.items() if a for x in (F.lit(f), F.lit(a))]
    return F.create_map(*hits) if hits else F.lit(None).cast("map<string,string>")


def recommend_from_attribution(df: DataFrame, features: Sequence[str], churns: Column, limit: int = 5) -> DataFrame:
    """Adds `recommendations`: at most `limit` of (action, impact); impact is 100 |value|, half-even to one digit.

    Needs the columns of :func:`topk_attribution`.  Several features may suggest the same action.
    """
    fixed = "struct<action: string, impact: double>"

    def note(action: str) -> Column:
        return F.struct(F.lit(action).alias("action"), F.lit(None).cast("double").alias("impact")).cast(fixed)

    def matched(pairs: str, book: Column, most: int) -> Column:
        # rounding is dear, so it comes after the pairs that are kept
        kept = F.slice(F.filter(ref(pairs), lambda p: F.element_at(book, p["feature"]).isNotNull()), 1, most)
        return F.transform(
            kept, lambda p: F.struct(F.element_at(book, p["feature"]).alias("action"), F.bround(F.abs(p["value"]) * 100.0, 1).alias("impact")).cast(fixed)
        )

    # each for the rows that show it
    drivers = F.when(churns.cast("boolean"), matched("risk_increasers", _actions_for(features, churn_action), limit))
    anchors = F.when(~F.coalesce(churns.cast("boolean"), F.lit(False)), matched("risk_decreasers", _actions_for(features, stay_action), 1))
    # columns of their own, so that each is computed once
    found = df.withColumns({"__drivers": drivers, "__anchors": anchors})
    leave = F.concat(F.when(F.size("__drivers") > 0, F.col("__drivers")).otherwise(F.array(note("RETENTION_CALL"))), F.array(note("CONTACT_48H")))
    stay = F.concat(F.array(note("KEEP_SERVICE")), F.col("__anchors"))
    return found.withColumn("recommendations", F.slice(F.when(churns.cast("boolean"), leave).otherwise(stay), 1, limit)).drop("__drivers", "__anchors")


def tree_arrays(model: PipelineModel) -> list[dict]:
    """Every tree of an ensemble as flat arrays plus its weight in the margin, read from the saved form.

    The size is that of the model (trees x nodes), which MLlib itself holds on the driver.
    """
    from ..session import scratch_path

    stage = model.stages[-1]
    spark = SparkSession.active()
    path = scratch_path(spark, "trees")
    stage.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    weights = [float(w) for w in stage.treeWeights]
    boosted = type(stage).__name__.startswith("GBT")
    trees: dict[int, dict[int, object]] = {}
    for r in nodes.collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    out = []
    for t in sorted(trees):
        rows = [trees[t][i] for i in sorted(trees[t])]
        if not boosted:
            value = [float(r["impurityStats"][1]) / max(float(sum(r["impurityStats"])), 1e-300) for r in rows]
        else:
            value = [float(r["prediction"]) for r in rows]
        for r in rows:
            if r["leftChild"] >= 0 and r["split"]["numCategories"] != -1:
                raise ValueError("categorical splits are not supported; encode levels as 0/1 features")
        out.append(
            {
                # a boosted margin is half the log-odds
                "weight": 2.0 * weights[t] if boosted else 1.0 / len(trees),
                "left": [r["leftChild"] for r in rows],
                "right": [r["rightChild"] for r in rows],
                "feature": [r["split"]["featureIndex"] for r in rows],
                "cut": [float(r["split"]["leftCategoriesOrThreshold"][0]) if r["leftChild"] >= 0 else 0.0 for r in rows],
                "value": value,
                "cover": [float(r["rawCount"]) for r in rows],
            }
        )
    return out


def baseline(trees: Sequence[Mapping]) -> float:
    """Expected margin over the training rows: the value all attributions start from."""
    total = 0.0
    for t in trees:
        leaves = [i for i, c in enumerate(t["left"]) if c < 0]
        total += t["weight"] * sum(t["value"][i] * t["cover"][i] for i in leaves) / t["cover"][0]
    return total


def _tree_attributor(trees: Sequence[Mapping], features: Sequence[str], keep: Sequence[str]):
    """Shapley values of a tree ensemble with path-dependent weights, for a whole Arrow batch at a time.

    Within a leaf each distinct feature on its path either admits a row (1) or not (0), and is otherwise passed
    with the share of training rows that took the path.  The leaf's contribution to a feature is a sum over
    subsets of the others, which only depends on subset sizes, so it is read off a polynomial in one variable.
    """
    features, keep = list(features), list(keep)

    def leaf_paths():
        paths = []
        for t in trees:
            stack = [(0, {})]
            while stack:
                node, seen = stack.pop()
                if t["left"][node] < 0:
                    if seen:
                        paths.append((t["weight"] * t["value"][node], seen))
                    continue
                f, c = t["feature"][node], t["cut"][node]
                for child, is_left in ((t["left"][node], True), (t["right"][node], False)):
                    share = t["cover"][child] / t["cover"][node]
                    lo, hi, z = seen.get(f, (float("-inf"), float("inf"), 1.0))
                    bounds = (lo, min(hi, c), z * share) if is_left else (max(lo, c), hi, z * share)
                    stack.append((child, {**seen, f: bounds}))
        return paths

    def run(batches):
        import math

        import numpy as np
        import pandas as pd

        paths = leaf_paths()
        for pdf in batches:
            x = pdf[[f"__f{i}" for i in range(len(features))]].to_numpy(dtype=float)
            phi = np.zeros_like(x)
            for value, seen in paths:
                fs = list(seen)
                m = len(fs)
                lo = np.array([seen[f][0] for f in fs])
                hi = np.array([seen[f][1] for f in fs])
                z = np.array([seen[f][2] for f in fs])
                part = x[:, fs]
                one = ((part > lo) & (part <= hi)).astype(float)
                # coefficients of prod over features of (z + one * t), by subset size
                poly = np.zeros((len(x), m + 1))
                poly[:, 0] = 1.0
                for j in range(m):
                    poly[:, 1 : j + 2] = poly[:, 1 : j + 2] * z[j] + poly[:, : j + 1] * one[:, [j]]
                    poly[:, 0] *= z[j]
                sizes = [math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)]
                for j in range(m):
                    o = one[:, j]
                    # divide the factor of feature j out again: for rows that pass, from the highest power down, where
                    # z <= 1 only multiplies; for others the factor is the number z, positive as every branch saw rows
                    down = np.zeros((len(x), m))
                    down[:, m - 1] = poly[:, m]
                    for s in range(m - 1, 0, -1):
                        down[:, s - 1] = poly[:, s] - z[j] * down[:, s]
                    rest = np.where(o[:, None] > 0, down, poly[:, :m] / z[j])
                    phi[:, fs[j]] += value * (o - z[j]) * (rest @ np.array(sizes))
            out = {k: pdf[k] for k in keep}
            out["__values"] = list(phi)
            yield pd.DataFrame(out)

    return run


def attribution_tree(df: DataFrame, model: PipelineModel, features: Sequence[str], keep: Sequence[str] = (), trees: Sequence[Mapping] | None = None) -> DataFrame:
    """Attributions of a boosted or forest model per row; with :func:`baseline` they add up to the margin, which is the
    log-odds for a boosted model and the probability for a forest.

    A pure map over Arrow batches.  The tree arrays travel with the task; they are as large as the model.
    """
    trees = tree_arrays(model) if trees is None else trees
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[ref(k) for k in keep]).schema]
    schema = ", ".join([*fields, "`__values` array<double>"])
    inputs = df.select(*[ref(k) for k in keep], *[ref(f).cast("double").alias(f"__f{i}") for i, f in enumerate(features)])
    valued = inputs.mapInPandas(_tree_attributor(trees, features, keep), schema)
    named = F.zip_with(F.array(*[F.lit(f) for f in features]), F.col("__values"), lambda f, v: F.struct(f.alias("feature"), v.alias("value")))
    return valued.select(*[ref(k) for k in keep], named.cast(PAIRS).alias("attribution"))
