"""Questions against facts and passages: which entities a question names, and the passage that answers best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estateloom.functions.skew import salted_join
from estateloom.operators import extraction, retrieval

# Words too common to show what a passage is about.
NOISE = [
    "the", "and", "for", "with", "from", "are", "is", "was", "what", "which", "who", "how", "does", "that", "this", "any", "all", "into", "must",
    "should", "will", "can", "not", "migration", "migrate", "service", "services", "application", "applications", "system", "systems", "use", "used",
    "uses", "using", "current", "requirements", "requirement",
]


def terms(text: Column) -> Column:
    """Distinct content words of a text, short technical ones included."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9.%-]*"), F.lit(0)), lambda w: F.regexp_replace(w, r"[.-]+$", ""))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*NOISE)))


def named_entities(documents: DataFrame, claims: DataFrame) -> DataFrame:
    """(name, n_questions, n_claims): names of entities that questions mention, with the facts there are about them.

    Questions meet names on the first word of the name, then the whole name must stand in the question.
    """
    bare = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    names = claims.where("lower(attribute) = 'name' and value is not null").select(bare(F.col("value")).alias("name"), "claim_id").where(F.length("name") >= 4).groupBy("name").agg(F.countDistinct("claim_id").alias("n_claims"))
    firsts = names.withColumn("word", F.substring_index("name", " ", 1))
    words = extraction.open_questions(documents).select("key", "n", F.explode(F.array_distinct(F.split("key", " "))).alias("word"))
    hits = salted_join(words, firsts, ["word"], ["key"], "inner").where(F.concat(F.lit(" "), "key", F.lit(" ")).contains(F.concat(F.lit(" "), "name", F.lit(" "))))
    return hits.groupBy("name").agg(F.count("*").alias("n_questions"), F.sum("n").alias("n_asked"), F.max("n_claims").alias("n_claims"))


def passages(documents: DataFrame, questions: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, doc_id, passage, hits): of each question's ``k`` best documents the sentence with most of its words (the first among equals).

    ``questions`` has query_id and text. Documents come from the word index, sentences are scored inside their row.
    """
    found = retrieval.bm25(documents, questions, k).select("query_id", "doc_id", "place")
    texts = documents.select("doc_id", "text")
    joined = found.join(texts, "doc_id").join(questions.select("query_id", terms(F.col("text")).alias("wanted")), "query_id")
    sentences = F.filter(F.flatten(F.transform(F.split("text", "\n"), lambda line: F.split(line, r"(?<=[.!?])\s+"))), lambda s: F.trim(s) != "")
    scored = F.transform(sentences, lambda s, i: F.struct(F.size(F.array_intersect(terms(s), F.col("wanted"))).alias("hits"), (-i).alias("at"), F.trim(s).alias("passage")))
    best = joined.select("query_id", "doc_id", "place", F.array_max(scored).alias("b")).where("b.hits > 0")
    return best.select("query_id", "doc_id", "place", F.left("b.passage", F.lit(280)).alias("passage"), F.col("b.hits").alias("hits"))


def recent_entries(events: DataFrame, k: int = 3) -> DataFrame:
    """The last ``k`` entries of each user's log, newest first."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return events.withColumn("place", place).where(F.col("place") <= k).select("user_id", "place", "event_id", "event_type")


def first_of_sources(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Union by ``key``: rows of ``first`` win over rows of ``second``."""
    both = first.withColumn("source", F.lit(0)).unionByName(second.withColumn("source", F.lit(1)))
    others = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.min(F.struct("source", *(c for c in others if c != "source"))).alias("r")).select(key, "r.*")
