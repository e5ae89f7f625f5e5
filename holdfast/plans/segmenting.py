"""Customer segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BANKING, ECOMMERCE, SEGMENT_NAMES, TELECOM
from ..operators import clean, segments
from . import oracle_views as V
from .dashboards import banking, ecommerce, telecom
from .registry import query

_FEATURES = ("tenure", "MonthlyCharges")


def _ruled(spark: SparkSession, base: str) -> DataFrame:
    """Accounts with a rule-made cluster number, so that SQL can follow."""
    return telecom(spark, base).withColumn("segment", F.least(F.floor(F.col("tenure") / 13), F.lit(3)).cast("int"))


_RULED = """ruled AS (SELECT *, least(floor(tenure / 13.0::DOUBLE), 3)::INTEGER AS segment, CASE WHEN "Churn" = 'Yes' THEN 1 ELSE 0 END AS gone FROM accounts),
  profile AS (SELECT segment, count(gone) AS customers, round_even(avg(gone), 2) AS churn_rate, round_even(round_even(avg(gone), 2) * 100, 1) AS churn_rate_pct,
    round_even(avg(tenure), 2) AS tenure, round_even(avg("MonthlyCharges"), 2) AS "MonthlyCharges" FROM ruled GROUP BY 1)"""
_NAMES = "[" + ", ".join(f"'{n}'" for n in SEGMENT_NAMES) + "]"
_RANKED = f"""{_RULED}, ranked AS (SELECT *, row_number() OVER (ORDER BY churn_rate DESC, segment)::INTEGER AS rank FROM profile),
  named AS (SELECT *, ({_NAMES})[rank] AS segment_name FROM ranked)"""


@query("segment_profile", f"WITH {V.ACCOUNTS}, {_RULED} SELECT * FROM profile")
def segment_profile(spark: SparkSession, base: str) -> DataFrame:
    return segments.segment_profile(_ruled(spark, base), _FEATURES)


def _named(spark: SparkSession, base: str) -> DataFrame:
    return segments.rank_segments(segments.segment_profile(_ruled(spark, base), _FEATURES))


@query("rank_segments", f"WITH {V.ACCOUNTS}, {_RANKED} SELECT segment, customers, churn_rate_pct, rank, segment_name FROM named")
def rank_segments(spark: SparkSession, base: str) -> DataFrame:
    return _named(spark, base).select("segment", "customers", "churn_rate_pct", "rank", "segment_name")


@query(
    "join_segment_names",
    f"""WITH {V.ACCOUNTS}, {_RANKED} SELECT "customerID", ruled.segment, segment_name FROM ruled LEFT JOIN named ON named.segment = ruled.segment""",
)
def join_segment_names(spark: SparkSession, base: str) -> DataFrame:
    return segments.join_segment_names(_ruled(spark, base), _named(spark, base)).select("customerID", "segment", "segment_name")


# Codes stand in for a caller's texts; the last name has none, so the default shows.
_PLANS = {name: (f"FIRST_{i}", f"SECOND_{i}") for i, name in enumerate(SEGMENT_NAMES[:3])}
_DEFAULT = ("UNPLANNED",)
_ACTIONS = ", ".join(f"('{n}', '{';'.join(a)}')" for n, a in _PLANS.items())


@query(
    "join_actions",
    f"""WITH {V.ACCOUNTS}, {_RANKED}, acts(segment_name, actions) AS (VALUES {_ACTIONS})
    SELECT segment, named.segment_name, coalesce(acts.actions, '{";".join(_DEFAULT)}') AS actions FROM named LEFT JOIN acts ON acts.segment_name = named.segment_name""",
)
def join_actions(spark: SparkSession, base: str) -> DataFrame:
    """With a table that lacks the fourth name, so the default shows."""
    joined = segments.join_actions(_named(spark, base), segments.action_table(spark, _PLANS), _DEFAULT)
    return joined.select("segment", "segment_name", F.array_join("actions", ";").alias("actions"))


@query(
    "segment_share",
    f"""WITH {V.ACCOUNTS}, {_RULED} SELECT segment, customers, round_even(customers * 100.0::DOUBLE / sum(customers) OVER (), 1) AS share_pct FROM profile""",
)
def segment_share(spark: SparkSession, base: str) -> DataFrame:
    share = segments.segment_share(_ruled(spark, base))
    return share.withColumn("share_pct", F.col("share_pct").cast("double"))


@query(
    "sample_per_group",
    f"""WITH {V.ACCOUNTS}, {_RULED} SELECT "customerID", segment FROM ruled
    QUALIFY row_number() OVER (PARTITION BY segment ORDER BY ('0x' || substr(md5("customerID" || '|42'), 1, 15))::UBIGINT, "customerID") <= 300""",
)
def sample_per_group(spark: SparkSession, base: str) -> DataFrame:
    return segments.sample_per_group(_ruled(spark, base).select("customerID", "segment"), "segment", "customerID", 300)


_SEGMENTED = " UNION ALL ".join(
    f"""SELECT '{ind.key}' AS industry, 4 AS segments, 4 AS ranks, (SELECT count(*) FROM {table} WHERE {" AND ".join(f'"{c}" IS NOT NULL' if c != "TotalCharges" else "total_num IS NOT NULL" for c in ind.segment_features)}) AS customers"""
    for ind, table in ((TELECOM, "accounts"), (BANKING, "clients"), (ECOMMERCE, "shoppers"))
)


@query("kmeans_segments", f"WITH {V.ACCOUNTS}, {V.CLIENTS}, {V.SHOPPERS} {_SEGMENTED}")
def kmeans_segments(spark: SparkSession, base: str) -> DataFrame:
    """Clustered, profiled and named segments of all three industries, summed up: every customer is in one of four."""
    sources = {
        TELECOM: clean.coerce_numeric(telecom(spark, base), ["TotalCharges"]),
        BANKING: banking(spark, base),
        ECOMMERCE: ecommerce(spark, base),
    }
    out: DataFrame | None = None
    for ind, df in sources.items():
        rows = df.select(*ind.segment_features, "churn")
        assigned = segments.kmeans_segments(rows, ind.segment_features, k=4)
        named = segments.rank_segments(segments.segment_profile(assigned, ind.segment_features)).select(
            F.lit(ind.key).alias("industry"), "segment", "customers", "churn_rate_pct", "rank", "segment_name"
        )
        out = named if out is None else out.unionByName(named)
    sums = [F.count("*").cast("int").alias("segments"), F.count_distinct("rank").cast("int").alias("ranks"), F.sum("customers").alias("customers")]
    return out.groupBy("industry").agg(*sums)
