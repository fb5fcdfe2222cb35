"""Every query runs; those with SQL give its rows."""

import glob
import math
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
#: Long loops over tiny tables; they are compared at scale 0.01 by the driver and over fixtures in test_operators.
SLOW = {"gr_dependents", "gr_depth"}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.fixture(scope="module")
def results(spark, sf):
    """Columns and rows of every query, several of them running at a time."""
    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(lambda q=q: (lambda df: (df.columns, df.collect()))(q(spark, sf))) for name, q in QUERIES.items() if name not in SLOW}


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{v + 0.0:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_against_sql(results, duck, name):
    columns, rows = results[name].result()
    cols = sorted(columns)
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [list(rel.columns).index(c) for c in cols]
    assert sorted("|".join(plain(r[c]) for c in cols) for r in rows) == sorted("|".join(plain(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(results, name):
    columns, _ = results[name].result()
    assert len(columns) == len(set(columns))


def test_entry(spark):
    got = entry.entry(spark)
    assert got.count() > 0 and got.columns == ["qid", "id", "score", "rank", "mmr_rank"]
