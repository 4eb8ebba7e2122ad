"""Every registered query against its SQL on the same tables."""

import os

import duckdb
import pytest

from voltmap.plans.registered import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(x):
        if x is None or isinstance(x, (bool, str)):
            return str(x)
        return repr(round(float(x), 9))

    return sorted(columns), sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    got = canon([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(SQL[name])
    want = canon(cur.fetchall(), [d[0] for d in cur.description])
    assert got == want
