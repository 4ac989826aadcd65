"""Every query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from siftlake.oracle import SQL
from siftlake.queries import QUERIES

HEAVY: set[str] = set()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(set(SQL) - HEAVY))
def test_query_gives_the_rows_of_its_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    relation = duck.sql(SQL[name])
    assert sorted(relation.columns) == columns
    where = [relation.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in where) for r in relation.fetchall())


def test_every_query_has_sql_or_is_known_not_to():
    assert set(QUERIES) - set(SQL) == {"near_dup_reviewed_pairs"}
