"""The driver's entry points, and a few queries against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from orbita.plans.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
CHECKED = ["distance_histogram", "apply_generator_packed", "apply_matrix_mod", "neighbors", "laplacian", "dataset_scan", "region_distance", "edges_truncated"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem", "events"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA)
    want = con.sql(ORACLE[name])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
