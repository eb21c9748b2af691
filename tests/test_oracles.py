"""Catalogue queries against their SQL twins in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from belegwerk.plans.catalog import QUERIES
from belegwerk.plans.oracles import oracles

SF_DIR = "/root/testdata/sf0.001"
# At the smallest size evaluation refuses, which the twin does not do.
LARGER = {"evaluate": "/root/testdata/sf0.01"}
ORACLES = oracles()


def duck(sf_dir):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, name):
    sf_dir = LARGER.get(name, SF_DIR)
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = duck(sf_dir).execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in places) for r in cursor.fetchall()]
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert ordered(got) == ordered(want)
