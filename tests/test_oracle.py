"""Every query against its SQL counterpart."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def show(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
        if hasattr(x, "quantize"):
            return repr(round(float(x), 6) + 0.0)
        return str(x)

    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in got.collect()]
    assert rows
    if name not in entry.oracle_sql():
        return
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(got.columns)
    assert canonical(rows, got.columns) == canonical(cur.fetchall(), cols)


def test_entry_has_rows(spark):
    assert entry.entry(spark).take(1)
