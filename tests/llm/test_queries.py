"""Registered queries of the training-data operators on the smallest tables, against SQL where there is some."""

from pathlib import Path

import duckdb
import pytest

from estateloom.llm import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    rows = [r.asDict() for r in df.collect()]
    assert rows
    if name in queries.ORACLES:
        con = duckdb.connect()
        con.execute("set timezone='UTC'")
        for p in DATA.glob("*.parquet"):
            con.execute(f"create view {p.stem} as select * from '{p}'")
        result = con.execute(queries.ORACLES[name])
        heads = [d[0] for d in result.description]
        want = [dict(zip(heads, r, strict=True)) for r in result.fetchall()]
        key = lambda rs: sorted(tuple(str(r[c]) for c in sorted(heads)) for r in rs)
        assert key(rows) == key(want)


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("p3_found", {"source_table": "string", "row_key": "string", "kind": "string", "pii_text": "string"}),
        ("p4_found", dict.fromkeys(["assessment_id", "entity_type", "entity_key", "attribute", "value_claim_id", "quote_claim_id"], "string")),
        ("p5_found", {"file_id": "bigint", "line_no": "int"}),
        ("p9_found", {"doc_id": "bigint", "start_pos": "bigint"}),
    ],
)
def test_given_columns(spark, name, columns):
    df = queries.QUERIES[name](spark, str(DATA))
    assert dict(df.dtypes) == columns
    assert df.count() == df.distinct().count()
