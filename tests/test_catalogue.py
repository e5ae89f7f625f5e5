"""Every cheap registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, canonical

SLOW = {
    "clf_forest", "clf_boost", "clf_mlp", "grid_search", "cross_val", "train_industry", "compare_families", "union_metrics", "model_registry", "topk_importance",
    "kmeans_segments",
}


@pytest.fixture(scope="module")
def con(base):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{base}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n not in SLOW])
def test_query_equals_sql(spark, base, con, name):
    got = entry.queries()[name](spark, base).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
