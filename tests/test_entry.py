"""The entry points: every query runs, and gives the rows of its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tokenloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def shown(x):
    return f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got, found = df.collect(), duck.execute(catalog.oracle_sql()[name])
    columns = sorted(c[0] for c in found.description)
    assert columns == sorted(df.columns)
    at = {c[0]: i for i, c in enumerate(found.description)}
    want = sorted(tuple(shown(r[at[c]]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in got) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registered():
    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_pieces_cover_documents(spark):
    assert catalog.queries()["pretokenize"](spark, SF).where("not covers_text").count() == 0
