import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(n for n in entry.registry.QUERIES)


def shown(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return "[" + ",".join(map(shown, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", OWN)
def test_query_matches_sql(spark, duck, name):
    found = entry.registry.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in found.select(*sorted(found.columns)).collect()]
    if name not in entry.registry.SQL:
        assert found.columns
        return
    want = duck.sql(entry.registry.SQL[name])
    columns = sorted(want.columns)
    assert sorted(found.columns) == columns
    other = want.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(tuple(map(shown, r)) for r in rows) == sorted(tuple(map(shown, r)) for r in other)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
