"""The registered queries against their SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ENGINE = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (not isinstance(x, (list, tuple, dict, np.ndarray)) and pd.isna(x)):
        return None
    if isinstance(x, (float, np.floating)):
        # Whole numbers beside missing ones are floats on one side and integers on the other.
        return int(x) if float(x).is_integer() else round(float(x), 5) + 0.0
    return int(x) if isinstance(x, (int, np.integer, np.bool_)) else x


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    return sorted(str([plain(v) for v in r]) for r in a[columns].astype(object).values.tolist()) == sorted(str([plain(v) for v in r]) for r in b[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", [n for n in ENGINE if n in entry.oracle_sql()])
def test_query_equals_sql(spark, sf, db, name):
    assert same(entry.queries()[name](spark, sf).toPandas(), db.sql(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", [n for n in ENGINE if n not in entry.oracle_sql()])
def test_query_runs(spark, sf, name):
    entry.queries()[name](spark, sf).collect()


def test_entry(spark):
    assert entry.entry(spark).columns == ["rank", "docno", "docid", "weight"]
