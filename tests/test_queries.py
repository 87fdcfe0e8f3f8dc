"""Registered queries against their SQL twins on the smallest data set."""

import glob
import os

import duckdb
import pytest

import verify
from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "T2_upsert", "T4_neighbours", "J5_track", "R6_both", "R29_batch", "N19_normalize", "P9_adapt", "M10_case_accuracy", "M13_latency",
    "K4_executable", "X6f_errors", "X17_audit", "F2_keywords", "A8_cdf", "Q7_references", "Z5_nearest", "S5_valid", "W1_wide",
)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(os.path.join(SF, "*.parquet")):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="data not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, con, name):
    df = queries()[name](spark, SF)
    cur = con.execute(oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert verify.rows_of(df.columns, df.collect()) == verify.rows_of(cols, cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="data not here")
def test_entry(spark):
    assert entry(spark).count() > 0
