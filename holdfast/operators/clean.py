"""Column maintenance: coercion, maps, null handling, alignment to a feature contract."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import nan_to_null, parse_number, ref


def text_columns(df: DataFrame, among: Iterable[str] | None = None) -> list[str]:
    wanted = None if among is None else set(among)
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and (wanted is None or f.name in wanted)]


def numeric_columns(df: DataFrame, among: Iterable[str] | None = None) -> list[str]:
    wanted = None if among is None else set(among)
    kinds = (T.NumericType, T.BooleanType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and (wanted is None or f.name in wanted)]


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


def select_existing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[ref(n) for n in names if n in df.columns])


def rename_export(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def coerce_numeric(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.withColumns({n: parse_number(ref(n)) for n in names})


def normalise_nan(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: nan_to_null(ref(n).cast("double")) for n in floats}) if floats else df


def parse_shares(df: DataFrame, names: Sequence[str]) -> dict[str, tuple[int, int]]:
    """(rows that parse, all rows) for every text column, in one aggregate."""
    if not names:
        return {}
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(parse_number(ref(n))).alias(f"c{i}") for i, n in enumerate(names)]).first()
    return {n: (row[f"c{i}"], row["n"]) for i, n in enumerate(names)}


def promotable(df: DataFrame, names: Sequence[str] | None = None, threshold: float = 0.8) -> list[str]:
    """Text columns of which strictly more than `threshold` of all rows parse as numbers."""
    shares = parse_shares(df, text_columns(df, names))
    return [n for n, (ok, total) in shares.items() if ok > total * threshold]


def promote_numeric(df: DataFrame, names: Sequence[str] | None = None, threshold: float = 0.8) -> DataFrame:
    return coerce_numeric(df, promotable(df, names, threshold))


def mapped(value: Column, mapping: Mapping[object, object]) -> Column:
    """Dictionary lookup as a `when` chain; anything unmapped becomes null."""
    out: Column | None = None
    for key, result in mapping.items():
        hit = value == F.lit(key)
        out = F.when(hit, F.lit(result)) if out is None else out.when(hit, F.lit(result))
    return F.lit(None) if out is None else out


def map_target(df: DataFrame, target: str, mapping: Mapping[object, int] | None) -> DataFrame:
    if not mapping:
        return df
    return df.withColumn(target, mapped(ref(target), mapping))


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    """Rows with a usable target, as int."""
    kind = df.schema[target].dataType
    if isinstance(kind, T.StringType):
        df = df.withColumn(target, parse_number(ref(target)))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        df = df.withColumn(target, nan_to_null(ref(target)))
    return df.na.drop(subset=[target]).withColumn(target, ref(target).cast("int"))


def drop_any_null(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=None if names is None else list(names))


def split_xy(df: DataFrame, target: str, keep: Sequence[str] = ()) -> DataFrame:
    """Feature columns first, the label as the double column `label`, then the columns to keep."""
    features = [c for c in df.columns if c != target and c not in keep]
    return df.select(*[ref(c) for c in features], ref(target).cast("double").alias("label"), *[ref(c) for c in keep])


# Ordinal and binary maps of the telecom table.
TELECOM_MAPS: dict[str, dict[str, int]] = {
    "gender": {"Male": 1, "Female": 0},
    "Partner": {"Yes": 1, "No": 0},
    "Dependents": {"Yes": 1, "No": 0},
    "PhoneService": {"Yes": 1, "No": 0},
    "PaperlessBilling": {"Yes": 1, "No": 0},
    "MultipleLines": {"No phone service": 0, "No": 1, "Yes": 2},
}


def map_encode(df: DataFrame, maps: Mapping[str, Mapping[str, int]] = TELECOM_MAPS) -> DataFrame:
    return df.withColumns({c: mapped(ref(c), m) for c, m in maps.items() if c in df.columns})


def as_double(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return ref(name).cast("int").cast("double")
    if isinstance(kind, T.NumericType):
        return ref(name).cast("double")
    return F.coalesce(parse_number(ref(name)), F.lit(0.0))


def cast_all_double(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Numbers and booleans by cast; text by parsing, with 0 for what does not parse."""
    return df.select(*[ref(c) if c in keep else as_double(df, c).alias(c) for c in df.columns])


def align_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The model's columns in the model's order; an absent one is 0.0."""
    present = set(df.columns)
    aligned = [(as_double(df, f) if f in present else F.lit(0.0)).alias(f) for f in features]
    return df.select(*[ref(k) for k in keep], *aligned)


def quarantine(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds `error`: the first present feature whose text is not a number, else null."""
    checks = [
        F.when(ref(f).isNotNull() & parse_number(ref(f)).isNull(), F.lit(f"not a number: {f}"))
        for f in features
        if f in df.columns and isinstance(df.schema[f].dataType, T.StringType)
    ]
    return df.withColumn("error", F.coalesce(*checks) if checks else F.lit(None).cast("string"))


def apply_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Missing record fields (null values or whole columns) take the industry's defaults."""
    present = set(df.columns)
    return df.withColumns({c: F.coalesce(ref(c), F.lit(v)) if c in present else F.lit(v) for c, v in defaults.items()})


def find_column(names: Iterable[str], contains: str, excludes: str | None = None) -> str | None:
    for name in names:
        low = name.lower()
        if contains in low and (excludes is None or excludes not in low):
            return name
    return None


def find_prob_column(df: DataFrame) -> str | None:
    return find_column(df.columns, "prob")


def find_churn_column(df: DataFrame) -> str | None:
    return find_column(df.columns, "churn", "prob")


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
    return df
