"""Claims against the documents they cite: resolution of references, grounding of quotes, locators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estateloom.functions.keys import col
from estateloom.functions.skew import salted_join
from estateloom.functions.typed_text import let


def _documents(documents: DataFrame) -> DataFrame:
    """One row per document, with the prefix by which chunk references name it."""
    return documents.groupBy("document_id").agg(F.first("filename").alias("filename"), F.first("doc_type").alias("doc_type"), F.max("precedence").alias("precedence")).withColumn("ref", F.substring_index("document_id", "-", 1))


def resolved_references(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Per document: references and claims that cite it; references to no document count under a null document."""
    refs = claims.dropDuplicates(["claim_id"]).select("claim_id", F.explode("evidence_refs").alias("chunk_id")).withColumn("ref", F.substring_index("chunk_id", "-", 1))
    joined = salted_join(refs, _documents(documents).select("ref", "document_id", "doc_type"), ["ref"], ["claim_id"], "left")
    return joined.groupBy("document_id", "doc_type").agg(F.count("*").alias("n_refs"), F.countDistinct("claim_id").alias("n_claims"), F.countDistinct("chunk_id").alias("n_chunks"))


def source_of_claims(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Each claim's document by its first reference; without one it is unsupported and its confidence at most 0.4."""
    c = claims.dropDuplicates(["claim_id"]).select("claim_id", "confidence", "source_document_id", F.substring_index(F.try_element_at("evidence_refs", F.lit(1)), "-", 1).alias("ref"))
    joined = salted_join(c, _documents(documents).select("ref", "document_id"), ["ref"], ["claim_id"], "left")
    conf = F.coalesce(F.nanvl("confidence", F.lit(None).cast("double")), F.lit(0.0))
    return joined.select(
        "claim_id", "document_id", F.col("document_id").isNull().alias("unsupported"), F.when(F.col("document_id").isNull(), F.least(conf, F.lit(0.4))).otherwise(conf).alias("confidence"),
        (F.col("document_id") == F.col("source_document_id")).alias("agrees"),
    )


def dangling_sources(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Claims whose source document does not exist: an anti join."""
    named = claims.where("source_document_id is not null").select("claim_id", F.col("source_document_id").alias("document_id")).distinct()
    return named.join(documents.select("document_id").distinct(), "document_id", "left_anti")


def flattened(c: Column | str) -> Column:
    return F.regexp_replace(F.trim(F.lower(col(c))), r"\s+", " ")


def is_grounded(quote: Column | str, text: Column | str) -> Column:
    """Is the quote, without a path in brackets before it, in the text: whole, or its first or last 40 characters?"""
    bare = F.regexp_replace(F.trim(col(quote)), r"^\[[^\]]+\]\s*", "")

    def check(x: Column) -> Column:
        needles = F.array(x["raw"], F.left(x["raw"], F.lit(40)), F.right(x["raw"], F.lit(40)), x["bare"], F.left(x["bare"], F.lit(40)), F.right(x["bare"], F.lit(40)))
        return F.exists(needles, lambda n: (F.length(n) >= 6) & x["hay"].contains(n))

    return F.coalesce(let(F.struct(flattened(quote).alias("raw"), flattened(bare).alias("bare"), flattened(text).alias("hay")), check), F.lit(False))


def grounded_values(claims: DataFrame) -> DataFrame:
    """Per attribute: claims, and those whose value stands in their own quote."""
    c = claims.dropDuplicates(["claim_id"]).where("value is not null and evidence_quote is not null")
    return c.groupBy(F.translate(F.lower("attribute"), " -", "__").alias("attribute")).agg(F.count("*").alias("n"), F.count_if(is_grounded("value", "evidence_quote")).alias("n_grounded"))


def evidence_spans(claims: DataFrame) -> DataFrame:
    """(claim, first and last chunk number it cites, number of chunks): an interval of each claim's evidence."""
    n = F.regexp_extract("chunk_id", r"-c(\d+)$", 1).try_cast("int")
    return claims.dropDuplicates(["claim_id"]).select("claim_id", F.explode("evidence_refs").alias("chunk_id")).groupBy("claim_id").agg(F.min(n).alias("first_chunk"), F.max(n).alias("last_chunk"), F.countDistinct("chunk_id").alias("n_chunks"))
