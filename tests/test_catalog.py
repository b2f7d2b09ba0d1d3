"""Every query with an oracle, against DuckDB at the smallest scale."""

import math

import duckdb
import pytest

from timedtext import catalog, catalog_jobs

D = "/root/testdata/sf0.001"
Q, SQL = catalog.queries() | catalog_jobs.queries(), catalog.oracle_sql() | catalog_jobs.oracle_sql()


def canon(rows):
    def cell(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        return round(float(x), 6) if isinstance(x, float | int) and not isinstance(x, bool) else x

    return sorted((tuple(cell(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents", "conversations", "embeddings", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got = Q[name](spark, D)
    columns = sorted(got.columns)
    cursor = con.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    assert canon([tuple(r[c] for c in columns) for r in got.collect()]) == canon(want)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(Q)
