"""Each query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from corvane import queries_more, queries_reports, queries_scoring  # noqa: F401  they add theirs
from corvane.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, bool | str):
        return str(x)
    if isinstance(x, int | float) or hasattr(x, "as_tuple"):
        return f"{float(x):.7g}"
    return str(x).replace("+00:00", "")


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    rows = got.collect()
    if name not in ORACLE_SQL:
        assert len(rows) > 0
        return
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, rows) == rows_of(want.columns, want.fetchall())


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
