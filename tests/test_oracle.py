"""Every query that SQL can state gives the same rows in DuckDB on the smallest test tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("op_"))
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(rows):
    return sorted((tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert {c: TYPES.get(t, t) for c, t in got.dtypes} == {c: str(t) for c, t in zip(want.columns, want.types, strict=True)}
    at = [want.columns.index(c) for c in columns]
    assert plain([tuple(r[c] for c in columns) for r in got.collect()]) == plain([tuple(r[i] for i in at) for r in want.fetchall()])


def test_every_query_without_sql_is_known():
    without = {n for n in __spark_entry__.queries() if n.startswith("op_")} - set(__spark_entry__.oracle_sql())
    assert without == {"op_als", "op_als_blend", "op_girvan_newman", "op_bfr_seed", "op_bfr_residual", "op_bfr_merge_cs", "op_bfr_recluster_rs", "op_bfr", "op_bfr_round_stats", "op_hierarchical"}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
