"""The driver contract: names, SQL counterparts, and equality with them where the shared tables are at hand."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return int(v) if type(v).__name__.startswith(("int", "uint")) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no shared tables")
@pytest.mark.parametrize("name", sorted(entry.catalog.QUERIES))
def test_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, str(DATA))
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda x: sorted((tuple(map(plain, r)) for r in x), key=repr)
    assert rows(got.select(*columns).collect()) == rows(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="no shared tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
