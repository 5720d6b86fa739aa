"""Every query with an SQL twin gives the same rows in an independent engine."""

import glob
import math
import os

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry

SCALES = ["sf0.001", "sf0.01"]


@pytest.fixture(scope="module", params=SCALES)
def scale(request):
    folder = f"{DATA}/{request.param}"
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return folder, db


def key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float) and math.isnan(a):
        return math.isnan(b)
    return a == b and type(a) is type(b)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, scale, name):
    folder, db = scale
    got = entry.queries()[name](spark, folder)
    want = db.execute(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    order = [d[0] for d in want.description]
    assert columns == sorted(order)
    rows = sorted(([r[c] for c in columns] for r in got.collect()), key=key)
    expected = sorted(
        ([r[order.index(c)] for c in columns] for r in want.fetchall()), key=key
    )
    assert len(rows) == len(expected)
    for mine, other in zip(rows, expected):
        assert all(same(a, b) for a, b in zip(mine, other)), (mine, other)


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs_without_twin(spark, name):
    assert entry.queries()[name](spark, f"{DATA}/sf0.001").count() > 0
