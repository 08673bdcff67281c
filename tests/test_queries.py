"""Every core query against its SQL in DuckDB, and what the entry module promises."""

import duckdb
import pytest

from tabwright import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents labels embeddings conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(core.queries()))
def test_same_as_sql(spark, sf_dir, duck, name):
    got, want = core.queries()[name](spark, sf_dir).toPandas(), duck.execute(core.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d.notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
