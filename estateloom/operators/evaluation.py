"""Scores of predictions against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_scores(pairs: DataFrame) -> DataFrame:
    """(label, tp, predicted, expected, precision, recall, f1) over (predicted, expected) rows; an empty side scores 0."""
    one = pairs.select(F.col("predicted").alias("label"), F.lit(1).alias("p"), F.lit(0).alias("e"), (F.col("predicted") == F.col("expected")).cast("int").alias("tp"))
    two = pairs.select(F.col("expected").alias("label"), F.lit(0).alias("p"), F.lit(1).alias("e"), F.lit(0).alias("tp"))
    sums = one.unionByName(two).where("label is not null").groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("p").alias("predicted"), F.sum("e").alias("expected"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    scored = sums.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("expected")))
    both = F.col("precision") + F.col("recall")
    return scored.select("label", "tp", "predicted", "expected", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"), F.round(ratio(2 * F.col("precision") * F.col("recall"), both), 4).alias("f1"))


def ranking_scores(rankings: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall_at_k, precision_at_k, reciprocal_rank): rankings are (query_id, item, place), relevant (query_id, item).

    Recall is 1 where nothing is relevant; precision and reciprocal rank are 0 where nothing relevant was found.
    """
    n = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    top = rankings.where(F.col("place") <= k)
    hits = top.join(relevant.withColumn("hit", F.lit(1)), ["query_id", "item"], "left").groupBy("query_id").agg(F.count("*").alias("n_top"), F.count("hit").alias("n_hit"), F.min(F.when(F.col("hit") == 1, F.col("place"))).alias("first"))
    both = hits.join(n, "query_id", "full")
    found = F.coalesce("n_hit", F.lit(0))
    return both.select(
        "query_id", F.when(F.coalesce("n_relevant", F.lit(0)) == 0, 1.0).otherwise(found / F.col("n_relevant")).alias("recall_at_k"),
        F.when(F.coalesce("n_top", F.lit(0)) == 0, 0.0).otherwise(found / F.col("n_top")).alias("precision_at_k"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def coverage(expected: DataFrame, found: DataFrame, group: str, key: str) -> DataFrame:
    """Per group: keys in both, only expected, only found, and the share of expected ones found (1 where nothing was expected)."""
    a = expected.select(group, key).distinct().withColumn("e", F.lit(True))
    b = found.select(group, key).distinct().withColumn("f", F.lit(True))
    counts = a.join(b, [group, key], "full").groupBy(group).agg(
        F.count_if(F.col("e") & F.col("f")).alias("n_both"), F.count_if(F.col("f").isNull()).alias("n_missing"), F.count_if(F.col("e").isNull()).alias("n_unexpected")
    )
    wanted = F.col("n_both") + F.col("n_missing")
    return counts.withColumn("recall", F.round(F.when(wanted == 0, 1.0).otherwise(F.col("n_both") / wanted), 4))


def script_of(documents: DataFrame) -> DataFrame:
    """(doc_id, predicted, expected): the language that a text's script allows to tell, beside the given one."""
    counts = {"th": "[฀-๿]", "hi": "[ऀ-ॿ]", "ar": "[؀-ۿ]", "ja": "[぀-ヿ]", "zh": "[一-鿿]", "ru": "[Ѐ-ӿ]"}
    n = documents.where("text is not null and lang is not null").select("doc_id", F.lower("lang").alias("lang"), *(F.length(F.regexp_replace("text", f"[^{p[1:]}", "")).alias(k) for k, p in counts.items()))
    most = F.greatest(*counts)
    kind = F.when(most == 0, "latin").when(F.col("ja") > 0.1 * F.col("zh"), F.when(F.greatest("th", "hi", "ar", "ru") > F.col("ja"), "other").otherwise("ja"))
    for k in ("th", "hi", "ar", "ru", "zh"):
        kind = kind.when(F.col(k) == most, k)
    expected = F.when(F.col("lang").isin(*counts), F.col("lang")).otherwise("latin")
    return n.select("doc_id", kind.otherwise("other").alias("predicted"), expected.alias("expected"))
