"""Entity-attribute-value rows into one wide, typed row per entity.

Each (entity, attribute) is resolved by a map-side-combinable aggregate, the resolved pairs of an entity become one map,
and known keys are projected from the map into typed columns. Text that cannot be cast is retained in ``cast_failures``;
attributes without a typed column stay in ``others``. No window and no collect: a key that holds any share of the rows is
reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estateloom.functions import typed_text as T
from estateloom.functions.keys import attribute_key, entity_key, is_blank, says_something, strip

_PCT, _GB, _H, _D, _B = T.percent, T.gigabytes, T.hours, T.date, T.boolean

#: typed column -> conversion from text
TYPED: dict[str, Callable[[Column], Column]] = {
    "vcpus": lambda c: T.whole_number(c, "vcpus?|cores?|cpus?|c"),
    "users_count": lambda c: T.whole_number(c, "users?"),
    "memory_gb": _GB,
    "disk_gb": _GB,
    "size_gb": _GB,
    "cpu_utilization_pct": _PCT,
    "rto_hours": _H,
    "decommission_date": _D,
    "go_live_date": _D,
    "licence_end": _D,
    "pci_scope": _B,
    "internet_facing": _B,
    "encrypted": _B,
}
ENTITY = ["assessment_id", "entity_type", "entity_key"]


def resolved_pairs(claims: DataFrame) -> DataFrame:
    """One (entity, attribute, text): the selected claim with the highest ``ord``; its override unless blank, else its value."""
    text = F.when(is_blank("override_value"), F.col("value")).otherwise(F.col("override_value"))
    return (
        claims.where("is_selected")
        .select("assessment_id", "entity_type", entity_key("entity_type", "entity_key").alias("entity_key"), attribute_key("attribute").alias("attribute"), "ord", text.alias("text"))
        .groupBy(*ENTITY, "attribute")
        .agg(F.max_by(F.struct("text"), F.coalesce("ord", F.lit(-(2**62)))).getField("text").alias("text"))
        .where(says_something("text"))
    )


def wide_entities(claims: DataFrame) -> DataFrame:
    """One row per entity: typed columns, ``others`` (map of text) and ``cast_failures`` (map of the text as it stands).

    Edge cases: rows with null ``is_selected`` are not selected; a null ``ord`` is lower than any other; rows with a null entity key, type or assessment form their own
    group; a null attribute or one whose text says nothing gives no cell; redelivered rows change nothing; an entity without any cell has
    no row; an empty table gives an empty table; further columns are ignored.
    """
    maps = (
        resolved_pairs(claims).where("attribute is not null").groupBy(*ENTITY)
        .agg(F.map_from_entries(F.collect_list(F.struct("attribute", "text"))).alias("pairs"))
    )
    at = lambda name: F.element_at("pairs", F.lit(name))
    typed = maps.select(*ENTITY, "pairs", *(cast(at(name)).alias(name) for name, cast in TYPED.items()))
    failed = F.array_compact(F.array(*(F.when(at(n).isNotNull() & F.col(n).isNull(), F.struct(F.lit(n).alias("key"), at(n).alias("value"))) for n in TYPED)))
    others = F.map_filter("pairs", lambda k, _: ~k.isin(*TYPED))
    return typed.select(*ENTITY, *TYPED, others.alias("others"), F.map_from_entries(failed).alias("cast_failures"))


def cells(wide: DataFrame) -> DataFrame:
    """The non-empty cells of the wide table as text: plain numbers, ISO dates, true/false, stripped text."""

    def shown(name: str) -> Column:
        cast = TYPED[name]
        if cast in (_GB, _PCT, _H):
            return T.plain_number(F.col(name))
        return F.col(name).cast("string")

    known = F.array_compact(F.array(*(F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("attribute"), shown(n).alias("cell"))) for n in TYPED)))
    rest = F.transform(F.map_entries("others"), lambda e: F.struct(e["key"].alias("attribute"), strip(e["value"]).alias("cell")))
    return wide.select(*ENTITY, F.inline(F.concat(known, rest)))
