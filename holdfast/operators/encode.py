"""Fit/transform feature preparation.

Fitting runs a handful of aggregates; the fitted state is plain numbers and names, so the transform is
nothing but column expressions: one narrow stage for training and serving alike.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nan_to_null, parse_number, ref
from ..session import materialised, scratch_path
from .clean import as_double, numeric_columns, promotable, text_columns
from .order_stats import medians, numbered
from .profile import levels, modes_and_cardinality, moments, value_counts

#: Levels beyond which a sparse vector carries its size only: Spark's encoder names every level in the schema, on the driver.
NAMED_LEVELS = 100_000

# Services counted by `total_services`.
SERVICES = ("OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies")


def onehot_columns(source: Column, name: str, levels_: Sequence[str], drop_first: bool = True) -> dict[str, Column]:
    """One 0/1 double per level; the first level, unseen values and nulls are all zeros."""
    kept = list(levels_)[1:] if drop_first else list(levels_)
    return {f"{name}_{lvl}": F.when(source == F.lit(lvl), F.lit(1.0)).otherwise(F.lit(0.0)) for lvl in kept}


def onehot_encode(df: DataFrame, fitted: Mapping[str, Sequence[str]]) -> DataFrame:
    new: dict[str, Column] = {}
    for name, levels_ in fitted.items():
        new.update(onehot_columns(ref(name), name, levels_))
    return df.withColumns(new).drop(*fitted)


def level_index(df: DataFrame, columns: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """(column, value, index): the place of every level among the sorted levels of its column, however many there are."""
    found = value_counts(df, columns) if counts is None else counts.filter(F.col("column").isin(list(columns)))
    return numbered(found.select("column", "value"), ["value"], "index", by=["column"])


def _marked(place: Column, size: int) -> Column:
    """A vector of `size` with a one at `place`; all zeros where that is `size`.  The schema holds its size, and no name per level."""

    @F.udf(VectorUDT())
    def vector(i):
        return Vectors.sparse(size, [int(i)], [1.0]) if i < size else Vectors.sparse(size, [], [])

    return vector(place)


def sparse_onehot(df: DataFrame, index: DataFrame, sizes: Mapping[str, int], suffix: str = "_levels", named: int = NAMED_LEVELS) -> DataFrame:
    """`df` with a sparse vector per column of `sizes` (its number of levels), one entry per level but the first.

    The index is joined back by value, so nothing of it has to fit the plan or the driver; the first level, unseen values and
    nulls are all zeros, as in `onehot_columns`.  Vectors of up to `named` levels have attributes in the schema.
    """
    if not sizes:
        return df
    out = df
    for i, (name, size) in enumerate(sizes.items()):
        own = index.filter(F.col("column") == name).select(F.col("value").alias(f"__v{i}"), F.col("index").alias(f"__i{i}"))
        out = out.join(own, ref(name) == F.col(f"__v{i}"), "left").drop(f"__v{i}")
        # the encoder leaves out the last category: the first level and what has none
        out = out.withColumn(f"__i{i}", F.when(F.col(f"__i{i}") > 0, F.col(f"__i{i}") - 1).otherwise(size - 1).cast("double"))
    marks = {f"__i{i}": (f"{c}{suffix}", n) for i, (c, n) in enumerate(sizes.items())}
    few = {m: (c, n) for m, (c, n) in marks.items() if n <= named}
    if few:
        widest = df.sparkSession.createDataFrame([tuple(float(n - 1) for _, n in few.values())], ", ".join(f"{m} double" for m in few))
        out = OneHotEncoder(inputCols=list(few), outputCols=[c for c, _ in few.values()], dropLast=True).fit(widest).transform(out)
    for m, (c, n) in marks.items():
        if m not in few:
            out = out.withColumn(c, _marked(ref(m), n - 1)).withMetadata(c, {"ml_attr": {"num_attrs": n - 1}})
    return out.drop(*marks)


def standardize(value: Column, mean: float, std: float) -> Column:
    """(x - mean) / std; a constant column becomes 0."""
    if not std:
        return F.when(value.isNotNull(), F.lit(0.0))
    return (value - F.lit(mean)) / F.lit(std)


def standardize_columns(df: DataFrame, fitted: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: standardize(ref(c).cast("double"), m, s) for c, (m, s) in fitted.items()})


def fill_na(df: DataFrame, stats: Mapping[str, object]) -> DataFrame:
    text = set(text_columns(df))
    out = {}
    for c, v in stats.items():
        source = ref(c) if c in text else nan_to_null(ref(c).cast("double"))
        out[c] = F.coalesce(source, F.lit(v))
    return df.withColumns(out)


def median_impute_fit(df: DataFrame, columns: Sequence[str], exact: bool = True) -> dict[str, float]:
    return {c: (0.0 if m is None else m) for c, m in medians(df, columns, exact=exact).items()}


def mode_impute_fit(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    return {c: m for c, (m, _) in modes_and_cardinality(df, columns).items()}


def add_total_services(df: DataFrame, services: Sequence[str] = SERVICES) -> DataFrame:
    """Row-wise count of the `_Yes` service columns that exist; 0 when there is none."""
    flags = [ref(c) for c in df.columns if c.endswith("_Yes") and any(s in c for s in services)]
    total = F.lit(0.0)
    for flag in flags:
        total = total + F.coalesce(flag.cast("double"), F.lit(0.0))
    return df.withColumn("total_services", total)


@dataclass
class Preparation:
    """Fitted state of the generic preparation; JSON in, JSON out."""

    numeric: list[str]
    numeric_fill: dict[str, float]
    text: list[str]
    text_fill: dict[str, str]
    levels: dict[str, list[str]]
    features: list[str]
    mean: dict[str, float] = field(default_factory=dict)
    std: dict[str, float] = field(default_factory=dict)
    # text columns with too many levels for a feature each: their numbers of levels, and where the index of levels is stored
    wide: dict[str, int] = field(default_factory=dict)
    index: str | None = None

    def imputed(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Source columns with missing values filled.  A column the table lacks is taken as missing."""
        present = set(df.columns)
        strings = set(text_columns(df))
        out: list[Column] = [ref(k) for k in keep]
        for c in self.numeric:
            if c not in present:
                value = F.lit(None).cast("double")
            elif c in strings:
                value = parse_number(ref(c))
            else:
                value = nan_to_null(as_double(df, c))
            out.append(F.coalesce(value, F.lit(float(self.numeric_fill[c]))).alias(f"__n_{c}"))
        for c in self.text:
            value = ref(c).cast("string") if c in present else F.lit(None).cast("string")
            out.append(F.coalesce(value, F.lit(self.text_fill[c])).alias(f"__t_{c}"))
        return df.select(*out)

    def transform(self, df: DataFrame, keep: Sequence[str] = (), scale: bool = True) -> DataFrame:
        """Two projections: filling first, so that every level of a text column reads the filled value.

        A wide column becomes one sparse vector, `<column>_levels`, by a join with the index of its levels.
        """
        cols: dict[str, Column] = {c: ref(f"__n_{c}") for c in self.numeric}
        for c in self.text:
            if c not in self.wide:
                cols.update(onehot_columns(ref(f"__t_{c}"), c, self.levels[c]))
        if scale and self.mean:
            cols = {f: standardize(c, self.mean[f], self.std[f]) for f, c in cols.items() if f in self.mean}
        rows = self.imputed(df, keep)
        if self.wide:
            index = df.sparkSession.read.schema("column string, value string, index bigint").parquet(self.index)
            rows = sparse_onehot(rows, index.withColumn("column", F.concat(F.lit("__t_"), "column")), {f"__t_{c}": n for c, n in self.wide.items()})
            cols.update({f"{c}_levels": ref(f"__t_{c}_levels") for c in self.wide})
        return rows.select(*[ref(k) for k in keep], *[cols[f].alias(f) for f in self.features])

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Preparation:
        return Preparation(**json.loads(text))


def fit_preparation(
    df: DataFrame,
    target: str | None = None,
    drop: Sequence[str] = (),
    threshold: float = 0.8,
    max_levels: int = 1000,
    scale: bool = True,
    exact: bool = True,
) -> Preparation:
    """Learn promotion, imputation, levels and scaling from `df` (pass the training rows only).

    A text column with more than `max_levels` values is a sparse vector feature, which every family takes; SMOTE does not.
    """
    used = [c for c in df.columns if c != target and c not in set(drop)]
    # read by six aggregates, so it is computed once
    df = materialised(df.select(*[ref(c) for c in used if c in {*numeric_columns(df, used), *text_columns(df, used)}]), "to-prepare")
    used = df.columns
    promoted = set(promotable(df, used, threshold))
    numeric = [c for c in used if c in promoted or c in set(numeric_columns(df, used))]
    text = [c for c in text_columns(df, used) if c not in promoted]
    text = [c for c in used if c in set(text)]
    parsed = df.select(
        *[(parse_number(ref(c)) if c in promoted else as_double(df, c)).alias(c) for c in numeric], *[ref(c) for c in text]
    )
    fill = median_impute_fit(parsed, numeric, exact)
    counts = materialised(value_counts(parsed, text), "levels") if text else None
    top = modes_and_cardinality(parsed, text, counts=counts)
    text_fill = {c: m for c, (m, _) in top.items()}
    wide = {c: k for c, (_, k) in top.items() if k > max_levels}
    narrow = [c for c in text if c not in wide]
    found = levels(parsed, narrow, max_levels, {c: top[c][1] for c in narrow}, counts.filter(F.col("column").isin(narrow)) if wide else counts)
    for c in narrow:
        if not found[c]:
            found[c] = [text_fill[c]]
    path = None
    if wide:
        path = scratch_path(df.sparkSession, "level-index")
        level_index(parsed, list(wide), counts).select("column", "value", "index").write.parquet(path)
    single = list(numeric) + [f"{c}_{lvl}" for c in narrow for lvl in found[c][1:]]
    prep = Preparation(numeric, fill, text, text_fill, found, single + [f"{c}_levels" for c in wide], wide=wide, index=path)
    if scale:
        stats = moments(prep.transform(df, scale=False), single)
        prep.mean = {f: m for f, (m, _) in stats.items()}
        prep.std = {f: s for f, (_, s) in stats.items()}
    return prep
