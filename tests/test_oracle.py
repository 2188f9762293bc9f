"""Every query against its SQL in DuckDB, over the same tables."""

import glob
import math
import os

import duckdb
import pytest

from tapeworks import catalog

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


#: Queries that may rightly have no row on the tables under test.
EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def canon(rows):
    fix = lambda v: ("n",) if v is None or isinstance(v, float) and math.isnan(v) else (f"{v:.9g}",) if isinstance(v, float) else (str(v),)
    return sorted(tuple(fix(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    found = catalog.queries()[name](spark, SF)
    order = sorted(found.columns)
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == order
    rows = [tuple(r[names.index(c)] for c in order) for r in want.fetchall()]
    got = [tuple(r[c] for c in order) for r in found.collect()]
    assert got or name in EMPTY
    assert len(got) == len(rows) and canon(got) == canon(rows)
