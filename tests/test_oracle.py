"""Every query with SQL gives DuckDB's rows on the sf0.001 tables."""

import os

import duckdb
import pytest

from siftlake import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(repr(float(r[k])) if isinstance(r[k], float) else repr(r[k]) for k in order) for r in rows))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name in catalog.ORACLE_SQL:
        want = db.execute(catalog.ORACLE_SQL[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(got.columns)
        assert canonical(rows, got.columns) == canonical(want.fetchall(), names)
    else:
        assert rows
