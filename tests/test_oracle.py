"""Every registered query against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from rasterlake.plans.queries import QUERIES
from rasterlake.plans.sql import ORACLE_SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return float(v) if hasattr(v, "dtype") or isinstance(v, (int, float)) else v

    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(None if v is df.__class__ or str(v) == "<NA>" else v) for v in r) for r in df[cols].itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).df())


def test_queries_without_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry_module_without_the_corpus_operators(monkeypatch):
    import importlib.util

    import __spark_entry__ as entry

    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n in ("rasterlake.llm", "corpus_pipeline") else find(n, *a))
    assert set(entry.queries()) == set(QUERIES)
    assert set(entry.oracle_sql()) == set(ORACLE_SQL)
