"""Every query that SQL can express, against DuckDB on the smallest tables."""

import pytest
from conftest import DATA

from roadlens.plans import registry

SF = DATA / "sf0.001"


def canonical(frame):
    cols = sorted(frame.columns)
    return sorted(tuple(None if x is None or x != x else round(float(x), 5) if isinstance(x, float) else str(x) for x in row) for row in frame[cols].astype(object).itertuples(index=False, name=None)) if len(frame) else []


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, str(SF)).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda rows: sorted(rows, key=repr)
    assert key(canonical(got)) == key(canonical(want))


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
