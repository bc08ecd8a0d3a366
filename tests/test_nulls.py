"""Tables with a row of nulls, repeated rows and further columns whose names clash with ones the operators make."""

import pytest
from pyspark.sql import functions as F

from estateloom.operators import parse_recovery, reconciliation, schema_drift, wide_entities

CLASHES = ["header", "reason", "cells", "text", "pairs", "union", "union_", "own", "fields", "field", "host", "n", "said", "precedence", "kind", "old", "new", "__salt", "row", "value_", "attribute_", "types", "at", "fact", "currency"]
INVENTORY = "line_id bigint, assessment_id string, file_id string, file_kind string, line_no int, raw_line string, received_at timestamp"
SERVERS = "record_id bigint, assessment_id string, feed_id string, file_seq int, row_no int, received_at timestamp, payload string"
CLAIMS = (
    "assessment_id string, claim_id string, ord bigint, entity_type string, entity_key string, attribute string, value string, override_value string, confidence double, evidence_quote string, evidence_refs array<string>, "
    "source_document_id string, unsupported boolean, needs_human_review boolean, review_status string, is_selected boolean, extracted_at timestamp, ingested_at timestamp"
)


def table(spark, schema, *rows):
    fields = [f.split()[0] for f in schema.split(", ")]
    data = [tuple(r.get(f) for f in fields) for r in rows]
    df = spark.createDataFrame([*data, *data, (None,) * len(fields), (None,) * len(fields)], schema)
    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in fields})


@pytest.fixture(scope="module")
def claims(spark):
    base = {"assessment_id": "a", "entity_type": "server", "entity_key": "h", "is_selected": True, "evidence_refs": []}
    return table(spark, CLAIMS, base | {"claim_id": "1", "ord": 1, "attribute": "vcpus", "value": "4"}, base | {"claim_id": "2", "attribute": "os", "value": "x" * 100_000}, base | {"claim_id": "3", "ord": 3, "attribute": "vcpus", "value": ""})


def test_lines(spark):
    df = table(spark, INVENTORY, {"line_id": 1, "file_id": "f", "line_no": 1, "raw_line": "hostname,os,vcpu,notes"}, {"line_id": 2, "file_id": "f", "line_no": 2, "raw_line": "a,b,4," + "n" * 200_000}, {"line_id": 3, "file_id": "f", "line_no": 3})
    got = sorted((r.line_id, str(r.reason)) for r in parse_recovery.parse_lines(df).collect())
    assert got == [(2, "None"), (2, "None"), (3, "columns"), (3, "columns")]


def test_servers(spark):
    df = table(spark, SERVERS, {"record_id": 1, "feed_id": "f", "file_seq": 1, "payload": '{"Hostname": "a-b-1", "x": 1}'}, {"record_id": 2, "feed_id": "f", "file_seq": 2, "row_no": 1, "payload": '{"Hostname": "a-b-1", "y": "z"}'})
    assert {tuple(r)[2:] for r in schema_drift.changes(df).collect()} == {("removed", "x", ""), ("added", "", "y")}
    assert schema_drift.consistent_table(df).count() == 3
    assert schema_drift.type_branches(df).count() == 3


def test_claims(claims):
    assert {(r.attribute, r.cell[:2]) for r in wide_entities.cells(wide_entities.wide_entities(claims)).collect()} == {("os", "xx")}
    assert reconciliation.deduplicated(claims).count() >= 2
