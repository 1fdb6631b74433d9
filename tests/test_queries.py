"""Every query that has SQL gives what DuckDB gives on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from paysift.plans.oracle import ORACLE
from paysift.plans.queries import QUERIES
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events embeddings conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _plain(value):
    return round(value, 5) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.execute(ORACLE[name])
    names, columns = [d[0] for d in want.description], sorted(got.columns)
    assert sorted(names) == columns
    rows = [tuple(_plain(r[names.index(c)]) for c in columns) for r in want.fetchall()]
    assert sorted(map(str, (tuple(_plain(r[c]) for c in columns) for r in got.collect()))) == sorted(map(str, rows))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
