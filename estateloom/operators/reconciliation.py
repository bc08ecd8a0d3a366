"""Claims from many sources to one value: duplicates, conflicts, precedence winners, entities and merged key variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estateloom.functions import inventory as I
from estateloom.functions.keys import is_blank, slug
from estateloom.functions.skew import salted_join

GROUP = ["assessment_id", "entity_type", "entity_key", "attribute"]
DEFAULT_PRECEDENCE = 50


def canonical_claims(claims: DataFrame) -> DataFrame:
    """Claims under canonical keys, with the value they are compared by; redelivered rows once."""
    c = claims.dropDuplicates(["claim_id"]).where("value is not null")
    keyed = c.withColumn("entity_key", I.canonical_entity_key(F.col("entity_type"), F.col("entity_key"))).withColumn("attribute", I.canonical_attribute("attribute"))
    return keyed.withColumn("compared", I.comparison_value(F.col("attribute"), F.col("value"))).withColumn("confidence", F.coalesce(F.nanvl("confidence", F.lit(None).cast("double")), F.lit(0.0)))


def deduplicated(claims: DataFrame) -> DataFrame:
    """Of claims that say the same, the one of highest confidence (first among equals), at the place of the first."""
    return canonical_claims(claims).groupBy(*GROUP, "compared").agg(
        F.max_by("claim_id", F.struct("confidence", -F.col("ord"))).alias("claim_id"), F.max("confidence").alias("confidence"), F.min("ord").alias("ord"), F.count("*").alias("n_claims")
    )


def conflicts(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Groups whose claims say different things, and the claim that wins by source precedence, confidence and order."""
    precedence = documents.groupBy(F.col("document_id").alias("source_document_id")).agg(F.max("precedence").alias("precedence"))
    ranked = salted_join(canonical_claims(claims), precedence, ["source_document_id"], ["claim_id"], "left")
    rank = F.struct(F.coalesce("precedence", F.lit(DEFAULT_PRECEDENCE)), "confidence", -F.col("ord"))
    return ranked.groupBy(*GROUP).agg(
        F.countDistinct("compared").alias("n_values"), F.count("*").alias("n_claims"), F.max_by("claim_id", rank).alias("selected_claim_id"), F.max_by("compared", rank).alias("selected_value")
    ).where("n_values > 1")


def entities(claims: DataFrame) -> DataFrame:
    """One row per entity: its name (the last selected name claim, else the key), average confidence and attributes of all selected claims."""
    said = F.when(is_blank("override_value"), F.col("value")).otherwise(F.col("override_value"))
    selected = canonical_claims(claims).where("is_selected").withColumn("said", said)
    named = F.when(F.col("attribute") == "name", F.col("ord"))
    return selected.groupBy(*GROUP[:3]).agg(
        F.coalesce(F.trim(F.max_by("said", named)), F.col("entity_key")).alias("name"), F.round(F.avg("confidence"), 6).alias("confidence"),
        F.countDistinct("attribute").alias("n_attributes"), F.count("*").alias("n_claims"),
    )


def merged_variants(keys: DataFrame) -> DataFrame:
    """(kind, variant, canonical) of keys that differ only in separators; ``keys`` has kind, key, usage and name (may be null).

    The canonical form is the one that the entities' own names agree on, else the variant used most, with most separators.
    """
    compact = F.regexp_replace("key", "-", "")
    used = keys.groupBy("kind", "key").agg(F.sum("usage").alias("usage"))
    named = keys.withColumn("compact", compact).withColumn("own", slug("name")).where(F.regexp_replace("own", "-", "") == F.col("compact"))
    agreed = named.groupBy("kind", "compact").agg(F.min("own").alias("own"), F.max("own").alias("other")).where("own = other").select("kind", "compact", "own")
    groups = used.withColumn("compact", compact).groupBy("kind", "compact").agg(
        F.max_by("key", F.struct("usage", F.length("key") - F.length("compact"), "key")).alias("best"), F.min("key").alias("a"), F.max("key").alias("b")
    ).where("a <> b")
    chosen = groups.join(agreed, ["kind", "compact"], "left").select("kind", "compact", F.coalesce("own", "best").alias("canonical"))
    return used.withColumn("compact", compact).join(chosen, ["kind", "compact"]).where("key <> canonical").select("kind", F.col("key").alias("variant"), "canonical", "usage")
