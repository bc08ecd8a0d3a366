"""Every registered core query on the smallest tables, against its SQL where it has one."""

from pathlib import Path

import duckdb
import pytest

from estateloom.plans import oracles, queries

DATA = Path("/root/testdata/sf0.001")


def shown(v) -> str:
    return "null" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, str(DATA))
    columns, got = sorted(df.columns), [r.asDict() for r in df.collect()]
    sql = oracles.ORACLES.get(name)
    if sql is None:
        assert got
        return
    result = duck.execute(sql)
    heads = [d[0] for d in result.description]
    want = [dict(zip(heads, r, strict=True)) for r in result.fetchall()]
    assert sorted(heads) == columns
    key = lambda rows: sorted(tuple(shown(r[c]) for c in columns) for r in rows)
    assert key(got) == key(want)
