"""Every query against its SQL on the smallest tables, where they are there."""

import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(found, names):
    plain = lambda v: tuple(map(plain, v)) if isinstance(v, (list, tuple)) else bytes(v) if isinstance(v, (bytes, bytearray)) else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(plain(r[n]) for n in names) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    found = got.collect()
    if name in entry.oracle_sql():  # the others have tests of their own
        cursor = duck.execute(entry.oracle_sql()[name])
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(got.columns)
        want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
        assert rows(found, names) == rows(want, names)
