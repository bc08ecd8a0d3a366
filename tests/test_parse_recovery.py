import csv
import io
import json
from datetime import UTC, datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from estateloom.operators import parse_recovery as P

SCHEMA = "line_id bigint, assessment_id string, file_id string, file_kind string, line_no int, raw_line string, received_at timestamp"


def lines(spark, rows):
    now = datetime(2026, 1, 1, tzinfo=UTC)
    return spark.createDataFrame([(i, "a", f, "messy-inventory", n, raw, now) for i, (f, n, raw) in enumerate(rows)], SCHEMA)


def reasons(spark, rows):
    return {r.line_id: r.reason for r in P.parse_lines(lines(spark, rows)).collect()}


def test_reasons(spark):
    head = ("f", 1, "﻿hostname,os,vcpu,notes\r")
    got = reasons(
        spark,
        [
            head, ("f", 2, "a,b, 4 ,x\r"), ("f", 3, 'a,b,4,"two\nlines, and ""quotes"""'), ("f", 4, 'a,b,4,19" rack'), ("f", 5, 'a,b,4,"open'), ("f", 6, 'a,b,4,"x"y'),
            ("f", 7, "a,b,4"), ("f", 8, None), ("f", 9, ""), ("f", 10, "a,b,1025,x"), ("f", 11, "a,b,0016.00,x"), ("f", 12, "a,b,,x"), ("f", 13, "a,b,0,x"), ("f", 14, "a,b,٤,x"),
            ("f", 15, 'a,b,"four",19" x'), ("f", 16, "a,b,four"),
        ],
    )
    assert got == {1: None, 2: None, 3: "quoting", 4: "quoting", 5: "quoting", 6: "columns", 7: "columns", 8: "columns", 9: "value", 10: None, 11: None, 12: "value", 13: "value", 14: "quoting", 15: "columns"}


def test_other_separators_and_missing_header(spark):
    got = reasons(spark, [("s", 1, '"hostname";"os";"vcpu";"notes"'), ("s", 2, "a;b;4;x, y"), ("t", 1, "hostname\tos\tvcpu\tnotes"), ("t", 2, "a\tb\t4\tx;y"), ("none", 2, "a,b"), ("none", 3, "alone"), (None, 4, "a,b")])
    assert got == {1: None, 3: None, 4: "columns", 5: None, 6: "columns"}


def test_recovery_resumes_at_the_next_record():
    reason, offset, _, _, recovered, _ = P.parse_line('a,b,4,"open\nc,d,8,fine\nbad line\ne,f,2,"also, fine"', "hostname,os,vcpu,notes")
    assert (reason, offset) == ("quoting", 39)  # the first quote closes there; anchors are looked for from offset 6 on
    assert recovered == [(12, ["c", "d", "8", "fine"], 8, None), (32, ["e", "f", "2", "also, fine"], 2, None)]


def test_swallowed_neighbours_load_typed(spark):
    """A quote that is never closed swallowed three lines: two load, the one whose value fails stays with the error."""
    raw = 'a,b,4,"open\nc,d, 8 ,fine\r\ne,f,many,x\nbroken\ng,h,016,"last, one"'
    parsed = P.parse_lines(lines(spark, [("f", 1, "hostname,os,vcpu,notes"), ("f", 2, raw), ("f", 3, "i,j,2,x"), ("f", 4, 'k,l,zero,""')]))
    assert [(r.line_id, r.part, r.hostname, r.vcpu, r.notes) for r in P.loaded(parsed).orderBy("line_id", "part").collect()] == [(1, 1, "c", 8, "fine"), (1, 3, "g", 16, "last, one"), (2, 0, "i", 2, "x")]
    bad = {r.line_id: r for r in P.rejected(parsed).collect()}
    assert bad[1].reason == "quoting" and [x["detail"] is None if "detail" in x else True for x in json.loads(bad[1].recovered)] == [True, False, True]
    assert (bad[3].reason, bad[3].error_offset) == ("value", 4)  # where the cell stands


def test_loaded_rows_are_typed_and_empty_table_stays_empty(spark):
    parsed = P.parse_lines(lines(spark, [("f", 1, "hostname,role,os,vcpu,memory_gb,disk_gb,datacenter"), ("f", 2, "h,r,o,08,16,many,dc")]))
    row = P.loaded(parsed).collect()[0]
    assert (row.vcpu, row.memory_gb, row.disk_gb, row.notes) == (8, 16.0, None, None)
    assert P.parse_lines(lines(spark, []).limit(0)).count() == 0


def test_clashing_extra_columns(spark):
    df = lines(spark, [("f", 1, "hostname,os,vcpu,notes"), ("f", 2, "a,b,4,x")])
    from pyspark.sql import functions as F

    assert P.parse_lines(df.withColumn("header", F.lit("x")).withColumn("reason", F.lit("y"))).collect()[0].reason is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab",;\n x', max_size=6), min_size=2, max_size=5))
def test_written_records_round_trip(fields):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(fields)
    got, end = P.RecordGrammar(",").record(out.getvalue(), 0, True)
    assert got == fields and end == len(out.getvalue())
