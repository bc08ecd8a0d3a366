"""Results do not depend on the order or the partitioning of the input."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from estateloom.operators import evidence, parse_recovery, reconciliation, schema_drift, wide_entities
from estateloom.session import read_table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")

OPERATORS = {
    "deduplicated": (["claims"], reconciliation.deduplicated),
    "conflicts": (["claims", "source_documents"], reconciliation.conflicts),
    "entities": (["claims"], reconciliation.entities),
    "cells": (["claims"], lambda c: wide_entities.cells(wide_entities.wide_entities(c))),
    "sources": (["claims", "source_documents"], evidence.source_of_claims),
    "lines": (["inventory_lines"], lambda x: parse_recovery.rejected(parse_recovery.parse_lines(x))),
    "changes": (["server_inventory"], schema_drift.changes),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_order_and_partitions(spark, name):
    tables, f = OPERATORS[name]
    inputs = [read_table(spark, DATA, t) for t in tables]
    one = sorted(map(str, f(*(x.coalesce(1) for x in inputs)).collect()))
    many = sorted(map(str, f(*(x.repartition(7).sortWithinPartitions(F.rand(3)) for x in inputs)).collect()))
    assert one == many and one


def test_a_hot_key_changes_nothing_but_its_own_group(spark):
    """A third of all rows under one key: the other groups come out as before."""
    claims, documents = read_table(spark, DATA, "claims"), read_table(spark, DATA, "source_documents")
    n = claims.count()
    hot = spark.range(n // 2).select(
        F.lit("hot").alias("assessment_id"), F.concat(F.lit("hot-"), "id").alias("claim_id"), (F.col("id") + 10**6).alias("ord"), F.lit("server").alias("entity_type"), F.lit("hot-host").alias("entity_key"), F.lit("os").alias("attribute"),
        F.concat(F.lit("v"), F.col("id") % 5).alias("value"), F.lit(0.5).alias("confidence"), F.lit(True).alias("is_selected"), F.lit(None).cast("string").alias("source_document_id"),
    )
    both = claims.unionByName(hot, allowMissingColumns=True)
    for f in (lambda c: reconciliation.conflicts(c, documents), reconciliation.deduplicated, lambda c: wide_entities.cells(wide_entities.wide_entities(c))):
        plain = sorted(map(str, f(claims).collect()))
        assert sorted(map(str, f(both).where("assessment_id <> 'hot'").collect())) == plain
        assert f(both).where("assessment_id = 'hot'").count() >= 1
