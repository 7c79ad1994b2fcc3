"""Every registered query against its check SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from check import NAMES, canonical
from platefield.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in NAMES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["plate_id", "node_id", "x1", "y1", "x2", "y2"] and df.count() > 0


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, db, key):
    mine = canonical(entry.queries()[key](spark, FOLDER).toPandas())
    sql = entry.oracle_sql().get(key)
    assert sql, "every query has a check query"
    theirs = canonical(db.execute(sql).fetch_df())
    pd.testing.assert_frame_equal(mine, theirs, check_dtype=False, check_exact=True)
