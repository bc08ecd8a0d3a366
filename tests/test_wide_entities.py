import pytest
from pyspark.sql import functions as F

from estateloom.functions import typed_text as T
from estateloom.operators import wide_entities as W

SCHEMA = "assessment_id string, claim_id string, ord bigint, entity_type string, entity_key string, attribute string, value string, override_value string, is_selected boolean"


def cells(spark, rows):
    df = spark.createDataFrame([("a", str(o), o, *r) for o, *r in rows], SCHEMA)
    return {(r.entity_key, r.attribute): r.cell for r in W.cells(W.wide_entities(df)).collect()}


def test_resolution_and_types(spark):
    s = "server"
    got = cells(
        spark,
        [
            (1, s, " Host.corp ", "Memory GB", "8,192 MB", None, True), (2, s, "HOST", "memory_gb", "16", "  ", True), (3, s, "host", "memory-gb", "32", None, False), (4, s, "host", "vcpus", "16 or 32", None, True),
            (5, s, "host", "os", " RHEL 9 ", "n/a", True), (6, s, "host", "tier", None, " web ", True), (7, s, "10.1.2.3", "tier", "x", None, True), (8, "application", "a.b", "go_live_date", "05.02.2029", None, True),
            (9, "application", "a.b", "rto_hours", "100 min", None, True), (10, s, "host", "pci_scope", "Y", None, True), (11, s, "host", "tier2", "x", None, None), (12, s, "host", None, "x", None, True),
            (12, s, "host", None, "x", None, True),
        ],
    )
    assert got == {
        ("host", "memory_gb"): "16", ("host", "tier"): "web", ("10.1.2.3", "tier"): "x", ("a.b", "go_live_date"): "2029-02-05", ("a.b", "rto_hours"): "1.667", ("host", "pci_scope"): "true",
    }


def test_cast_failures_are_retained_and_empty_table(spark):
    df = spark.createDataFrame([("a", "1", 1, "server", "h", "vcpus", "lots", None, True)], SCHEMA)
    row = W.wide_entities(df).collect()[0]
    assert row.vcpus is None and row.cast_failures == {"vcpus": "lots"}
    assert W.wide_entities(df.limit(0)).count() == 0
    assert W.wide_entities(df.withColumn("text", F.lit(1)).withColumn("pairs", F.lit(2))).count() == 1


@pytest.mark.parametrize(
    ("kind", "text", "want"),
    [
        (T.gigabytes, "1,5 TB", 1536.0), (T.gigabytes, "1,572,864 MB", 1536.0), (T.gigabytes, "512 GiB", 512.0), (T.gigabytes, "12", 12.0), (T.gigabytes, "2 x 8 GB", None), (T.gigabytes, "1.234,5 GB", None), (T.gigabytes, "", None),
        (T.percent, "72.9 percent", 72.9), (T.percent, "84,6 %", 84.6), (T.hours, "3 days", 72.0), (T.hours, "0,5 h", 0.5), (T.hours, "30 min", 0.5), (T.boolean, "TRUE", True), (T.boolean, "maybe", None),
        (lambda c: T.whole_number(c, "cores?"), "012", 12), (lambda c: T.whole_number(c, "cores?"), "12.5", None), (lambda c: T.whole_number(c, "cores?"), "4 cores", 4),
        (lambda c: T.date(c).cast("string"), "Feb 30, 2027", None), (lambda c: T.date(c).cast("string"), "Oct 5, 2028", "2028-10-05"), (lambda c: T.date(c).cast("string"), "2028-06-28T00:00:00Z", "2028-06-28"),
        (lambda c: T.date(c).cast("string"), "5 Mar 2029", "2029-03-05"), (lambda c: T.date(c).cast("string"), "12/03/2026", None),
    ],
)
def test_typed_text(spark, kind, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(kind(F.col("t"))).first()[0] == want
