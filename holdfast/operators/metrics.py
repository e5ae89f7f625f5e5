"""Classifier metrics as aggregates over scored rows, optionally per group (model, industry, fold)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ref
from .order_stats import placed_by_ranges


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp per group in one partial-aggregated pass."""
    y, p = ref(label).cast("int"), ref(pred).cast("int")
    return df.groupBy(*[ref(b) for b in by]).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def _ratio(num: Column, den: Column) -> Column:
    """Zero where the denominator is zero."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def _rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    precision = _ratio(tp, tp + fp)
    recall = _ratio(tp, tp + fn)
    return precision, recall, _ratio(F.lit(2.0) * tp, F.lit(2) * tp + fp + fn)


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = (), digits: int = 1) -> DataFrame:
    """accuracy, precision, recall and f1 in percent, rounded half-even."""
    m = confusion_matrix(df, label, pred, by)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall, f1 = _rates(tp, fp, fn)
    total = tn + fp + fn + tp
    rows = {"accuracy": F.try_divide((tn + tp).cast("double"), total.cast("double")), "precision": precision, "recall": recall, "f1": f1}
    return m.select(*[ref(b) for b in by], *[F.bround(v * 100.0, digits).alias(n) for n, v in rows.items()])


def classification_report(
    df: DataFrame, label: str = "label", pred: str = "pred", names: tuple[str, str] = ("Stay", "Churn"), by: Sequence[str] = ()
) -> DataFrame:
    """Per class precision, recall, f1 and support, then accuracy, macro and weighted averages."""
    m = confusion_matrix(df, label, pred, by)
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    p1, r1, f1 = _rates(tp, fp, fn)
    p0, r0, f0 = _rates(tn, fn, fp)
    s0, s1 = tn + fp, fn + tp
    total = s0 + s1
    acc = F.try_divide(tn + tp, total)

    def line(name: str, precision: Column, recall: Column, f: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f.alias("f1"),
            support.cast("bigint").alias("support"),
        )

    def weighted(a: Column, b: Column) -> Column:
        return F.try_divide(a * s0 + b * s1, total)

    lines = F.array(
        line(names[0], p0, r0, f0, s0),
        line(names[1], p1, r1, f1, s1),
        line("accuracy", acc, acc, acc, total),
        line("macro avg", (p0 + p1) / 2.0, (r0 + r1) / 2.0, (f0 + f1) / 2.0, total),
        line("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f0, f1), total),
    )
    keys = [ref(b) for b in by]
    return m.select(*keys, F.explode(lines).alias("r")).select(*keys, "r.*")


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve with ties counted half.

    Rows are first combined to one row per distinct score and sorted by ranges.  The running count of negatives is taken in
    two phases: the parts of the sort are totalled, and a window counts inside each part, so no task sees them all.
    One class only gives null.
    """
    group = F.struct(*[ref(b).alias(f"g{i}") for i, b in enumerate(by)]) if by else F.struct(F.lit(0).alias("g0"))
    y = ref(label).cast("int")
    per_score = (
        df.filter(ref(score).isNotNull() & y.isNotNull())
        .groupBy(group.alias("__g"), ref(score).cast("double").alias("__s"))
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    )
    placed, dealt = placed_by_ranges(per_score, ["__g", "__s"], "scores")
    totals = placed.groupBy("__g", "__part").agg(F.sum("neg").alias("__neg"))
    upto = F.sum("__neg").over(Window.partitionBy("__g").orderBy("__part"))
    offsets = totals.select(F.col("__g").alias("__h"), F.col("__part").alias("__p"), (upto - F.col("__neg")).alias("offset"))
    inside = Window.partitionBy("__g", "__part").orderBy("__s")
    met = placed.repartition(dealt, "__g", "__part").join(offsets, (F.col("__g") == F.col("__h")) & (F.col("__part") == F.col("__p")))
    ranked = met.withColumn("below", F.col("offset") + F.sum("neg").over(inside) - F.col("neg"))
    area = F.col("pos").cast("double") * (F.col("below").cast("double") + F.col("neg").cast("double") / F.lit(2.0))
    return (
        ranked.groupBy("__g")
        .agg(F.sum(area).alias("a"), F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("q"))
        .select(*[F.col(f"__g.g{i}").alias(b) for i, b in enumerate(by)], F.try_divide(F.col("a"), F.col("p") * F.col("q")).alias("auc"))
    )


def compare_models(scored: DataFrame, model: str = "model", label: str = "label", score: str = "score", pred: str = "pred") -> DataFrame:
    """One row per model with all five metrics in percent."""
    table = binary_metrics(scored, label, pred, [model])
    auc = roc_auc(scored, label, score, [model]).withColumn("auc", F.bround(F.col("auc") * 100.0, 1))
    return table.join(auc, model)


def argmax_model(metrics: DataFrame, by: str = "auc", tie: str = "model") -> DataFrame:
    """The row with the largest metric; the first in `tie` order when several share it."""
    return metrics.orderBy(ref(by).desc_nulls_last(), ref(tie)).limit(1)


def highlight_max(metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds `<metric>_is_max` for every metric; the table has one row per model."""
    best = metrics.agg(*[F.max(ref(c)).alias(c) for c in columns]).first()
    return metrics.withColumns({f"{c}_is_max": F.coalesce(ref(c) == F.lit(best[c]), F.lit(False)) for c in columns})


def cv_summary(folds: DataFrame, by: Sequence[str] = (), value: str = "auc") -> DataFrame:
    return folds.groupBy(*[ref(b) for b in by]).agg(F.avg(ref(value)).alias("cv_auc"), F.stddev_pop(ref(value)).alias("cv_std"))
