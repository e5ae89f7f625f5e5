"""Exact order statistics without gathering a column in one task, by one algorithm at every size.

Values are tallied per group (a frequent value is combined before the shuffle), the tallies sorted by ranges, and running
counts taken in two phases: over the parts of the sort, of which there are few, and inside each part.  Then every tally
knows how many smaller values its group has, and wanted ranks are picked by a condition.  Groups are never listed in the
plan or on the driver, unless the caller asks for a dictionary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nan_to_null, ref
from ..session import materialised, tasks_for

Group = tuple
_KEY, _V = "__key", "__v"


def _values(df: DataFrame, column: str) -> Column:
    c = ref(column)
    return nan_to_null(c) if df.schema[column].dataType.typeName() in ("double", "float") else c


def _key(by: Sequence[str]) -> Column:
    """Group values as a struct, in which nulls equal each other."""
    return F.struct(*[ref(b).alias(f"g{i}") for i, b in enumerate(by)]) if by else F.struct(F.lit(0).alias("g0"))


def placed_by_ranges(df: DataFrame, keys: Sequence[str], name: str) -> tuple[DataFrame, int]:
    """(`df` sorted into parts by `keys`, with the number of the part as `__part`, and the number of parts).

    There are as many parts as the rows ask for, so that neither a part nor a task that several parts are dealt to grows with
    the table.  The rows are written first, which counts them and lets the sampling for the ranges read what is computed; the
    parts are written, so that all that read them see the same ones.
    """
    rows = materialised(df, f"{name}-rows")
    parts = tasks_for(rows.count())
    return materialised(rows.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()), name), parts


def ranked(rows: DataFrame) -> DataFrame:
    """(__key, __v) to one row per distinct value: n, before (smaller values of the group) and total."""
    tallies = rows.filter(F.col(_V).isNotNull()).groupBy(_KEY, _V).agg(F.count("*").alias("n"))
    placed, dealt = placed_by_ranges(tallies, [_KEY, _V], "tallies")
    parts = placed.groupBy(_KEY, "__part").agg(F.sum("n").alias("__m"))
    group = Window.partitionBy(_KEY)
    parts = parts.select(
        F.col(_KEY).alias("__k"), F.col("__part").alias("__p"), (F.sum("__m").over(group.orderBy("__part")) - F.col("__m")).alias("__first"), F.sum("__m").over(group).alias("total")
    )
    inside = Window.partitionBy(_KEY, "__part").orderBy(_V)
    whole = placed.repartition(dealt, _KEY, "__part")
    met = whole.join(parts, (whole[_KEY] == parts["__k"]) & (whole["__part"] == parts["__p"]))
    before = F.col("__first") + F.sum("n").over(inside) - F.col("n")
    return met.select(_KEY, _V, "n", before.alias("before"), "total")


def at_rank(rank: Column) -> Column:
    """The aggregate that picks the value at a zero-based rank from :func:`ranked` rows of one group."""
    return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col(_V)))


def quantile_table(df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.5,), by: Sequence[str] = ()) -> DataFrame:
    """(group columns, column, q): linearly interpolated quantiles of every column with a value, as an array."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _values(df, c).cast("double").alias("v")) for c in columns])
    long = df.select(_key(by).alias("g"), F.explode(pairs).alias("p"))
    rows = ranked(long.select(F.struct("g", F.col("p.column").alias("column")).alias(_KEY), F.col("p.v").alias(_V)))
    picks = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("total") - 1)
        picks += [at_rank(F.floor(pos)).alias(f"lo{i}"), at_rank(F.ceil(pos)).alias(f"hi{i}")]
    found = rows.groupBy(_KEY).agg(F.first("total").alias("total"), *picks)
    q = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("total") - 1)
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        q.append(F.when(lo == hi, lo).otherwise((F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi))
    groups = [F.col(f"{_KEY}.g.g{i}").alias(b) for i, b in enumerate(by)]
    return found.select(*groups, F.col(f"{_KEY}.column").alias("column"), F.array(*q).alias("q"))


def approximate_table(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str], accuracy: int) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _values(df, c).cast("double").alias("v")) for c in columns])
    long = df.select(*[ref(b) for b in by], F.explode(pairs).alias("__p")).filter("__p.v is not null")
    return long.groupBy(*[ref(b) for b in by], F.col("__p.column").alias("column")).agg(F.percentile_approx("__p.v", list(probs), accuracy).alias("q"))


def quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.5,), by: Sequence[str] = (), exact: bool = True, accuracy: int = 10_000
) -> dict[Group, dict[str, list[float | None]]]:
    """The quantile table as a dictionary on the driver, for groups that the caller knows to be few; null without values."""
    columns = list(columns)
    if not columns:
        return {}
    table = quantile_table(df, columns, probs, by) if exact else approximate_table(df, columns, probs, by, accuracy)
    if by:
        groups = df.select(*[ref(b) for b in by]).distinct()
        none = F.transform(F.lit(list(columns)), lambda c: F.struct(c.alias("column"), F.lit(None).cast("array<double>").alias("q")))
        table = table.unionByName(groups.withColumn("__c", F.explode(none)).select(*[ref(b) for b in by], "__c.column", "__c.q"))
    out: dict = {} if by else {(): {c: [None] * len(probs) for c in columns}}
    for r in table.collect():
        own = out.setdefault(tuple(r[b] for b in by), {c: [None] * len(probs) for c in columns})
        if r["q"] is not None:
            own[r["column"]] = list(r["q"])
    return out


def medians(df: DataFrame, columns: Sequence[str], exact: bool = True) -> dict[str, float | None]:
    return {c: q[0] for c, q in quantiles(df, columns, (0.5,), exact=exact).get((), {}).items()}


def select_ranks(df: DataFrame, column: str, ranks: Sequence[int]) -> dict[int, object]:
    """The value of `column` at each zero-based rank; ranks beyond the last value are left out."""
    rows = ranked(df.select(_key(()).alias(_KEY), _values(df, column).alias(_V)))
    row = rows.agg(*[at_rank(F.lit(r)).alias(f"r{i}") for i, r in enumerate(ranks)]).first()
    return {r: row[f"r{i}"] for i, r in enumerate(ranks) if row[f"r{i}"] is not None}


def cut_table(df: DataFrame, column: str, by: str, wanted: Sequence[Column]) -> DataFrame:
    """(by, cuts): per group the values at the ranks that `wanted` computes from the column `total`; null below rank 0."""
    rows = ranked(df.select(_key([by]).alias(_KEY), _values(df, column).alias(_V)))
    found = rows.groupBy(_KEY).agg(*[at_rank(w).alias(f"c{i}") for i, w in enumerate(wanted)])
    return found.select(F.col(f"{_KEY}.g0").alias(by), F.array(*[F.col(f"c{i}") for i in range(len(wanted))]).alias("cuts"))


def numbered(df: DataFrame, order: Sequence[str], column: str = "number", by: Sequence[str] = ()) -> DataFrame:
    """`df` with 0, 1, 2 ... in `order` (after `by`, and from 0 anew for each), without passing all rows through one task.

    Rows are sorted by ranges and written once; a part's numbers start after the rows of the parts before it.
    """
    keys = [ref(c) for c in (*by, *order)]
    parts = materialised(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "ranges")
    # a row per part, and per value of `by` that it holds
    sizes = parts.groupBy("__part", *[ref(c) for c in by]).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*[ref(c) for c in by]).orderBy("__part")) - F.col("__n")
    own = F.row_number().over(Window.partitionBy("__part", *[ref(c) for c in by]).orderBy(*[ref(c) for c in order])) - 1
    placed = parts.withColumn("__own", own).join(sizes.withColumn("__before", before).drop("__n"), ["__part", *by])
    return placed.withColumn(column, (F.col("__own") + F.col("__before")).cast("bigint")).drop("__part", "__own", "__before")
