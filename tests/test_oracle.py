"""Every registered query against its DuckDB oracle on the smallest fixture."""
import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from docshelf.plans.catalog import QUERIES as CATALOG
from docshelf.plans.catalog import load_all
from docshelf.sources.tables import TABLES

from .conftest import SF_SMALL

load_all()
QUERIES = {k: v for k, v in E.queries().items() if k in CATALOG}
ORACLE = {k: v for k, v in E.oracle_sql().items() if k in CATALOG}


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 9))
    return str(v)


def _hash(df):
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in df.to_dict("records"))
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


# queries that SQL cannot express, with the test that holds them against brute force
TESTED_ELSEWHERE = {"search_text": "tests/test_search.py"}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE) | set(TESTED_ELSEWHERE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = con.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert _hash(got) == _hash(want)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns == ["category", "n_files", "n_low", "avg_confidence"]
