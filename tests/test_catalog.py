"""Every registered query against its SQL on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from tessera.plans import catalog_schema  # noqa: F401
from tessera.plans.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    norm = lambda v: round(v, 5) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    return [names[k] for k in order], Counter(tuple(norm(r[k]) for k in order) for r in values)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_all_have_sql():
    assert set(QUERIES) - set(SQL) == {"refined"}  # a chain of steps, each of which has its own; tests/test_schema.py


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows(spark, oracle, name):
    found = QUERIES[name](spark, DATA)
    want = oracle.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(names, want.fetchall())
