"""Every query with SQL gives the SQL's rows on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from kairoframe.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def text(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(name, spark, sf, duck):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    done = duck.execute(catalog.oracle_sql()[name])
    theirs = [d[0] for d in done.description]
    assert sorted(theirs) == columns
    assert ours == sorted(tuple(text(r[theirs.index(c)]) for c in columns) for r in done.fetchall())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
