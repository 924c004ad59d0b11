"""Every query with SQL gives what DuckDB gives on the smallest tables; the others give rows of a stable schema."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from quillon.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return round(x, 5)
    if hasattr(x, "tolist"):
        x = x.tolist()
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else round(x, 5) if isinstance(x, float) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([plain(r[i]) for i in order]) for r in data))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, duck, name):
    df = catalog.queries()[name](spark, str(DATA))
    want = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    got = df.collect()
    assert got and rows(df.columns, got) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows(spark, name):
    df = catalog.queries()[name](spark, str(DATA))
    assert len(df.columns) == len(set(df.columns)) and df.count() > 0


def test_entry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["doc_id", "neg", "pos", "document_length"]
