"""Every registered query against DuckDB on the same tables."""

import os
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from queries.oracles import ORACLES
from queries.slate import QUERIES

FOLDER = os.environ.get("BOUGH_TEST_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def comparable(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(value):
        return float(value) if isinstance(value, Decimal) else value

    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    have, expected = comparable(got.collect(), got.columns), comparable(want.fetchall(), names)
    assert len(have) == len(expected)
    for mine, theirs in zip(have, expected):
        assert mine == theirs
