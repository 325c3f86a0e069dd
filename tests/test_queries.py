import os

import duckdb
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
NAMES = [n for n in __spark_entry__.catalogue.QUERIES]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("orders", "events"):
        path = f"{FOLDER}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    value = lambda v: None if v is None or v != v else round(v, 8) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, FOLDER)
    cursor = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(cursor.fetchall(), columns)
