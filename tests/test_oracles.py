"""Every registered query beside its check SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from leafwork.workload.oracles import ORACLES
from leafwork.workload.queries import QUERIES
from tests.conftest import SMALL

TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for name in ("documents", "pages", "conversations", "events"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return db


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_check(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    want = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == kinds
    assert _sorted(df.columns, df.collect()) == _sorted(want.columns, want.fetchall())


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() == 204  # every document, and four more that are empty
