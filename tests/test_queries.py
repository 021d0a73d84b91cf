"""Every query that has SQL against DuckDB, at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as e

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def oracle():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: round(float(v), 4) if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(clean(r[i]) for i in order) for r in data)


from tidelake.plans.queries import oracle_sql as table_sql  # noqa: E402


@pytest.mark.parametrize("name", sorted(table_sql()))
def test_against_duckdb(spark, name):
    got = e.queries()[name](spark, SF)
    want = oracle().execute(e.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_entry(spark):
    assert e.entry(spark).count() > 0
