"""Queries of the core, by name: callables of (session, folder of tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from estateloom.plans import estate_queries, fact_queries
from estateloom.operators import parse_recovery, schema_drift, wide_entities
from estateloom.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return parse_recovery.parse_lines(read_table(spark, d, "inventory_lines"))


QUERIES: dict[str, Query] = {
    "p1_found": lambda s, d: _parsed(s, d).where("reason is not null").select("line_id", "reason").distinct(),
    "p1_rejected": lambda s, d: parse_recovery.rejected(_parsed(s, d)),
    "p1_loaded": lambda s, d: parse_recovery.loaded(_parsed(s, d)),
    "p2_found": lambda s, d: schema_drift.changes(read_table(s, d, "server_inventory")),
    "p2_consistent": lambda s, d: schema_drift.consistent_table(read_table(s, d, "server_inventory")),
    "p2_branches": lambda s, d: schema_drift.type_branches(read_table(s, d, "server_inventory")),
    "p6_found": lambda s, d: wide_entities.cells(wide_entities.wide_entities(read_table(s, d, "claims"))),
    "p6_wide": lambda s, d: wide_entities.wide_entities(read_table(s, d, "claims")),
    **estate_queries.QUERIES,
    **fact_queries.QUERIES,
}
