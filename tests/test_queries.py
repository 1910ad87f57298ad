"""Every query with SQL against DuckDB, and none of them empty."""

import glob
import math
import os

import duckdb
import pytest

from lectern.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def norm(v):
    if hasattr(v, "item"):
        v = v.item()
    return None if isinstance(v, float) and math.isnan(v) else round(v, 8) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_duckdb(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    names = sorted(df.columns)
    got = sorted(repr(tuple(map(norm, r))) for r in df.select(*names).collect())
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == names
    rows = sorted(repr(tuple(map(norm, r))) for r in want.project(", ".join(f'"{c}"' for c in names)).fetchall())
    assert got and got == rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_have_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_heading_shapes_of_letters_that_grow_in_upper_case(spark, tmp_path):
    """A line of 120 characters with a sharp s has 121 in upper case by Java's rules."""
    texts = ["Stra\u00dfe " + "x" * 113, "\u00df\u00df", "\u0149 a", "\u1fb3 \u1fbc", "A\ufb01 B\u00df", "", "\u00c9t\u00e9\nb\u00df " + "c" * 117]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(ORACLE_SQL["heading_shapes"]).project("doc_id, titles, uppers, headings").fetchall())
    assert sorted(map(tuple, QUERIES["heading_shapes"](spark, str(tmp_path)).select("doc_id", "titles", "uppers", "headings").collect())) == want
