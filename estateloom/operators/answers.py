"""Answers out of facts: standard questions, claims and links that a question asks for, evidence of answers, planned questions, decisions replayed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estateloom.functions.keys import attribute_key, is_blank, strip
from estateloom.functions.skew import salted_join
from estateloom.operators import extraction, reconciliation

# Standard questions, by the attributes (and, where given, entity types) of the facts that answer them.
STANDARD = [
    ("estate_inventory", ["name"], ["application", "server", "database"]),
    ("dependencies", ["dependency", "integration", "interface"], []),
    ("platform_compatibility", ["os", "runtime", "framework", "architecture"], []),
    ("service_levels", ["sla", "availability", "latency", "rto", "rpo", "scalability"], []),
    ("security_compliance", ["compliance", "encryption", "data_residency", "security"], []),
    ("migration_blockers", ["constraint", "gap", "tech_debt", "blocker"], []),
]
# Attributes that count as requirements, and words that ask for a link.
REQUIREMENT_ATTRIBUTES = ["sla", "rto", "rpo", "availability", "latency", "compliance", "data_residency", "encryption", "scalability", "nfr"]
RELATION_WORDS = ["depend", "depends", "dependency", "dependencies", "use", "uses", "using", "call", "calls", "connect", "connects", "integrate", "integrates", "integration", "hosted", "host", "hosts", "run", "runs", "talk", "talks"]


def _facts(claims: DataFrame) -> DataFrame:
    """Selected claims once each, with what they say after overrides and a confidence of 0 where it is missing."""
    said = F.when(is_blank("override_value"), F.col("value")).otherwise(F.col("override_value"))
    c = claims.where("is_selected").dropDuplicates(["claim_id"]).withColumn("attribute", attribute_key("attribute"))
    return c.withColumn("said", said).withColumn("conf", F.coalesce(F.nanvl("confidence", F.lit(None).cast("double")), F.lit(0.0)))


def standard_answers(claims: DataFrame) -> DataFrame:
    """Per assessment and standard question: facts, entities, mean confidence, whether all are supported and any needs review; no fact gives n_facts 0."""
    fits = [F.when(F.col("attribute").isin(*a) & (F.col("entity_type").isin(*t) if t else F.lit(True)), F.lit(q)) for q, a, t in STANDARD]
    facts = _facts(claims).select("assessment_id", "entity_type", "entity_key", "conf", "unsupported", "needs_human_review", F.size("evidence_refs").alias("refs"), F.explode(F.array_compact(F.array(*fits))).alias("question"))
    answered = facts.groupBy("assessment_id", "question").agg(
        F.count("*").alias("n_facts"), F.countDistinct("entity_type", "entity_key").alias("n_entities"), F.round(F.sum(F.col("conf").cast("decimal(18,6)")).cast("double") / F.count("*"), 2).alias("confidence"),
        F.bool_and((F.col("refs") > 0) & ~F.col("unsupported")).alias("supported"), F.bool_or("needs_human_review").alias("review"),
    )
    asked = claims.select("assessment_id").distinct().select("assessment_id", F.explode(F.array(*(F.lit(q) for q, _, _ in STANDARD))).alias("question"))
    return asked.join(answered, ["assessment_id", "question"], "left").select(
        "assessment_id", "question", F.coalesce("n_facts", F.lit(0)).alias("n_facts"), F.coalesce("n_entities", F.lit(0)).alias("n_entities"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("supported", F.lit(False)).alias("supported"), F.coalesce("review", F.lit(False)).alias("review"),
    )


def requirement_counts(claims: DataFrame) -> DataFrame:
    """Per assessment: selected claims that state requirements, by attribute or because they are about the business."""
    wanted = F.col("attribute").isin(*REQUIREMENT_ATTRIBUTES) | F.col("attribute").startswith("rto") | (F.col("entity_type") == "business")
    return _facts(claims).groupBy("assessment_id").agg(F.count_if(wanted).alias("n_requirements"), F.count("*").alias("n_claims"))


def _asked(documents: DataFrame) -> DataFrame:
    """(key, word) of the questions that texts ask."""
    return extraction.open_questions(documents).select("key", F.explode(F.array_distinct(F.split("key", " "))).alias("word"))


def _spoken(c: Column) -> Column:
    """Lower-case words with blanks around each, so that whole words can be looked for."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))


def matched_claims(documents: DataFrame, claims: DataFrame) -> DataFrame:
    """(key, tier, n_claims) of each question that facts speak to: the narrowest tier of claims that has any.

    Tier 1: the attribute that the question names, of an entity that it names; 2: the attribute, of any entity; 3: all facts of
    the named entity. Attributes and names meet the questions on their first word, salted, then as whole words; claims are
    counted per (attribute, name) before.
    """
    facts = _facts(claims)
    names = facts.where("attribute = 'name' and said is not null").groupBy("assessment_id", "entity_type", "entity_key").agg(F.max_by("said", F.struct("ord", "said")).alias("name"))
    counted = salted_join(facts.select("assessment_id", "entity_type", "entity_key", "attribute", "claim_id"), names, ["assessment_id", "entity_type", "entity_key"], ["claim_id"], "left").groupBy("attribute", _spoken(F.col("name")).alias("name")).agg(F.count("*").alias("n"))
    words = _asked(documents)

    def named(terms: DataFrame, column: str) -> DataFrame:
        firsts = terms.select(column).where(F.length(column) >= 4).distinct().withColumn("word", F.substring_index(F.trim(column), " ", 1))
        return salted_join(words, firsts, ["word"], ["key"], "inner").where(F.concat(F.lit(" "), F.col("key"), F.lit(" ")).contains(F.col(column))).select("key", column).distinct()

    attributes = counted.select("attribute", _spoken(F.translate("attribute", "_", " ")).alias("spoken")).distinct()
    by_attribute = named(attributes, "spoken").join(attributes, "spoken").select("key", "attribute").distinct()
    by_name = named(counted.where("name is not null"), "name")
    per_attribute = counted.groupBy("attribute").agg(F.sum("n").alias("n"))
    per_name = counted.where("name is not null").groupBy("name").agg(F.sum("n").alias("n"))
    tiers = (
        by_attribute.join(by_name, "key").join(counted, ["attribute", "name"]).select("key", F.lit(1).alias("tier"), "n")
        .unionByName(by_attribute.join(per_attribute, "attribute").select("key", F.lit(2).alias("tier"), "n"))
        .unionByName(by_name.join(per_name, "name").select("key", F.lit(3).alias("tier"), "n"))
    )
    best = tiers.groupBy("key", "tier").agg(F.sum("n").alias("n"))
    return best.groupBy("key").agg(F.min(F.struct("tier", "n")).alias("b")).select("key", "b.tier", F.col("b.n").alias("n_claims"))


def matched_links(documents: DataFrame) -> DataFrame:
    """(key, source, relation, target): links between components that a question with a word of relation names at either end."""
    edges = extraction.dependency_edges(documents).select("source", "relation", "target")
    ends = edges.select(F.explode(F.array("source", "target")).alias("end"), "source", "relation", "target").distinct().withColumn("word", F.substring_index("end", "-", 1))
    hits = salted_join(_asked(documents), ends, ["word"], ["key"], "inner")
    padded = F.concat(F.lit(" "), F.col("key"), F.lit(" "))
    asks = F.exists(F.array(*(F.lit(f" {w} ") for w in RELATION_WORDS)), lambda w: padded.contains(w))
    return hits.where(asks & padded.contains(F.concat(F.lit(" "), F.translate("end", "-", " "), F.lit(" ")))).select("key", "source", "relation", "target").distinct()


def answer_evidence(claims: DataFrame, most: int = 4) -> DataFrame:
    """(assessment_id, attribute, chunk_id, n_quotes, first_quote): the quotes, ``most`` at most in order, that a cited chunk gives to the answer of an attribute."""
    c = _facts(claims).where(~is_blank("evidence_quote")).select("assessment_id", "attribute", strip("evidence_quote").alias("quote"), "ord", F.explode("evidence_refs").alias("chunk_id"))
    once = c.groupBy("assessment_id", "attribute", "chunk_id", "quote").agg(F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy("assessment_id", "attribute", "chunk_id").orderBy("ord", "quote"))
    kept = once.withColumn("place", place).where(F.col("place") <= most)
    return kept.groupBy("assessment_id", "attribute", "chunk_id").agg(F.count("*").alias("n_quotes"), F.min_by("quote", "place").alias("first_quote"))


def planned_questions(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """(assessment_id, kind, question): what must be asked: conflicts that are open, and requirements nothing was found for."""
    conflicts = reconciliation.conflicts(claims, documents).groupBy("assessment_id").agg(F.count("*").alias("n"))
    who = conflicts.select("assessment_id", F.lit("conflicts").alias("kind"), F.concat(F.lit("There are "), F.col("n"), F.lit(" conflicting facts: who can confirm the right values?")).alias("question"))
    have = _facts(claims).groupBy("assessment_id").agg(F.collect_set(F.when(F.col("attribute").isin(*REQUIREMENT_ATTRIBUTES), F.col("attribute"))).alias("have"))
    gaps = have.withColumn("gaps", F.array_except(F.array(*(F.lit(a) for a in sorted(REQUIREMENT_ATTRIBUTES))), "have")).where(F.size("gaps") > 0)
    return who.unionByName(gaps.select("assessment_id", F.lit("gaps").alias("kind"), F.concat(F.lit("Nothing was found on "), F.array_join("gaps", ", "), F.lit(": does it apply, and with which values?")).alias("question")))


def questionnaire_items(documents: DataFrame) -> DataFrame:
    """(doc_id, item_no, question): lines of a questionnaire that ask something, numbers and marks before them dropped, the first of equal ones."""
    line = lambda x: F.trim(F.regexp_replace(x, r"^[\s#>*|-]*(?:[Qq]?[0-9]{1,3}[.):]\s*)?", ""))
    asks = F.filter(F.transform(F.split("text", "\n"), line), lambda x: x.rlike(r"^[^?]{8,}\?"))
    keyed = F.transform(asks, lambda x: F.regexp_extract(x, r"^[^?]+\?", 0))
    rows = documents.where("source = 'questionnaire' and text is not null").select("doc_id", F.posexplode(F.array_distinct(keyed)).alias("item_no", "question"))
    return rows


def replayed_decisions(claims: DataFrame) -> DataFrame:
    """(claim_id, status, override_value): pending claims that say what an earlier decision was about, with the latest such decision.

    Decisions are keyed by what they are about (assessment, entity, attribute, value), so they reach claims that were read
    anew under other ids; one decision may reach many claims.
    """
    key = ["assessment_id", "entity_type", "entity_key", "attribute", "said"]
    c = claims.dropDuplicates(["claim_id"]).withColumn("attribute", attribute_key("attribute")).withColumn("entity_key", F.lower(F.trim("entity_key"))).withColumn("said", F.lower(F.trim("value"))).where("said is not null")
    decided = c.where(F.col("review_status").isin("accepted", "rejected", "overridden")).groupBy(*key).agg(F.max_by(F.struct("review_status", "override_value"), F.struct("extracted_at", "claim_id")).alias("d"))
    pending = c.where("review_status = 'pending'").select(*key, "claim_id")
    return salted_join(pending, decided, key, ["claim_id"], "inner").select("claim_id", F.col("d.review_status").alias("status"), F.col("d.override_value").alias("override_value"))


def blocked_inputs(documents: DataFrame, first: int = 12, chars: int = 2000) -> DataFrame:
    """(assessment_id, n_read, n_injected, blocked): a gate over the leading texts of each assessment: nothing to read, or an injection, blocks."""
    place = F.row_number().over(Window.partitionBy("assessment_id").orderBy("doc_id"))
    head = documents.select("assessment_id", "doc_id", F.left("text", F.lit(chars)).alias("text")).withColumn("place", place).where(F.col("place") <= first)
    injected = F.exists(F.array(*(F.lit(f"(?i){p}") for p in extraction.INJECTION)), lambda p: F.regexp_like("text", p))
    read = ~is_blank("text")
    return head.groupBy("assessment_id").agg(F.count_if(read).alias("n_read"), F.count_if(F.coalesce(injected, F.lit(False))).alias("n_injected")).withColumn("blocked", (F.col("n_read") == 0) | (F.col("n_injected") > 0))
