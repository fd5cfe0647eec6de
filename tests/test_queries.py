"""Every query of the library against its DuckDB twin."""

import duckdb
import pytest

from ledgerlens import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return "NULL"
    return repr(float(v)) if isinstance(v, (int, float)) or getattr(getattr(v, "dtype", None), "kind", "") in tuple("iuf") else str(v)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(name, spark, duck):
    got = Q.QUERIES[name](spark, SF).toPandas()
    if name not in Q.ORACLE_SQL:
        assert len(got) > 0
        return
    want = duck.sql(Q.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = [sorted(map(tuple, x[columns].map(plain).values.tolist())) for x in (got, want)]
    assert rows[0] == rows[1]
