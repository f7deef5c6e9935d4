"""All registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from shelfspark.plans.oracles import ORACLES
from shelfspark.plans.queries import QUERIES

SF_DIR = Path("/root/testdata/sf0.001")
KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.skipif(not SF_DIR.exists(), reason="test tables are absent")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, str(SF_DIR))
    expected = duck.sql(ORACLES[name])
    order = sorted(found.columns)
    assert order == sorted(expected.columns)
    kinds = dict(zip(expected.columns, map(str, expected.types)))
    assert {f.name: KINDS[f.dataType.simpleString()] for f in found.schema.fields} == kinds
    rows = sorted((tuple(r[c] for c in order) for r in found.collect()), key=repr)
    at = [expected.columns.index(c) for c in order]
    assert rows == sorted((tuple(r[i] for i in at) for r in expected.fetchall()), key=repr)
