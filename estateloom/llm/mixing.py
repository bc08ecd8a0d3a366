"""Sources mixed to target shares of all tokens: capped water-filling, then seeded whole and fractional repetitions.

Each source may be used at most ``max_repeats`` times over. Its allotment is its share of the total; sources whose
allotment exceeds what they can give are clamped there, and the excess goes to the others in proportion to their targets
until nothing is exceeded. With ``of_all`` the total is the size of the whole corpus. Without a total the mix is the largest
in which no source is clamped, so that every source that has texts comes out at its target (shares of sources without texts
go to the others); the scarcest source then sets the size.

Only per-source totals, one row for each listed source, come to the driver. A fractional repetition takes texts in the
order of a seeded hash until its tokens are met: hash buckets are counted first, and only texts of the one bucket in which
a source's quota ends are ordered, so a source may hold any share of the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estateloom.llm.tokenizing import VOCABULARY, sized
from estateloom.session import checkpointed

BUCKETS = 4096
#: most sources that a list of targets may name
MAX_SOURCES = 10_000


@dataclass
class Allotment:
    source: str
    target: float
    available: int
    max_repeats: int
    tokens: float = 0.0

    @property
    def most(self) -> float:
        return float(self.available) * max(self.max_repeats, 0)

    @property
    def epochs(self) -> float:
        return min(self.tokens / self.available, float(self.max_repeats)) if self.available else 0.0


def water_fill(sources: list[Allotment], total: float | None = None) -> list[Allotment]:
    """Tokens of each source. The sum is ``total`` unless all sources together cannot give it."""
    live = [s for s in sources if s.most > 0 and s.target > 0]
    weight = sum(s.target for s in live)
    if not live:
        return sources
    if total is None:
        total = min(s.most / (s.target / weight) for s in live)
    left, free = float(total), list(live)
    while free:
        share = sum(s.target for s in free)
        clamped = [s for s in free if s.target / share * left > s.most * (1 + 1e-12)]
        if not clamped:
            for s in free:
                s.tokens = s.target / share * left
            break
        for s in clamped:
            s.tokens = s.most
            left -= s.most
        free = [s for s in free if s not in clamped]
    return sources


def allotments(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> list[Allotment]:
    named = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("source is not null")
    rows = named.orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources are listed")
    listed = sizes.sparkSession.createDataFrame([(r.source,) for r in rows], "source string")
    have = {r.source: r.available for r in sizes.join(F.broadcast(listed), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("available")).collect()}
    return water_fill([Allotment(r.source, r.target_share or 0.0, have.get(r.source) or 0, r.max_repeats or 0) for r in rows], total_tokens)


def _plan(sizes: DataFrame, plan: list[Allotment]) -> DataFrame:
    """(source, whole, quota) of each source that takes part, as a frame of one row per listed source."""
    rows = [(s.source, math.floor(s.epochs), s.tokens - math.floor(s.epochs) * s.available) for s in plan if s.tokens > 0]
    return sizes.sparkSession.createDataFrame(rows, "source string, whole int, quota double")


def _corpus_tokens(sizes: DataFrame) -> float:
    """Tokens of all texts, also of those without a listed source."""
    return float(sizes.agg(F.sum("n_tokens")).first()[0] or 0)


def mixed(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 0, vocabulary: str = VOCABULARY, of_all: bool = False) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of every text in the mix.

    Edge cases: texts with a null or unlisted source take no part; null and empty texts have no tokens and take none; a
    listed source without texts contributes nothing; a source listed twice counts with its larger values; null or
    non-positive targets and repeats count as 0; repeated texts are texts of their own; empty tables give an empty table.
    """
    sizes = checkpointed(sized(documents, ["doc_id", "source"], vocabulary))  # texts are tokenised once
    return _chosen(sizes, allotments(sizes, targets, _corpus_tokens(sizes) if of_all else total_tokens), seed)


def _chosen(sizes: DataFrame, plan: list[Allotment], seed: int) -> DataFrame:
    keyed = sizes.where("n_tokens > 0").join(F.broadcast(_plan(sizes, plan)), "source").withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    keyed = keyed.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    per = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"), F.first("quota").alias("quota"))
    before = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    ends = per.withColumn("before", F.coalesce(before, F.lit(0))).where("before < quota and before + tokens >= quota")  # one row per source
    cut = ends.select("source", F.col("bucket").alias("cut"), (F.col("quota") - F.col("before")).alias("rest"))
    placed = keyed.join(F.broadcast(cut), "source", "left")
    inside = placed.where("bucket = cut")
    running = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    # the text at which the quota ends is taken if that comes nearer to it
    last = inside.withColumn("more", ((running - F.col("n_tokens") / 2) <= F.col("rest")).cast("int"))
    # rounding leaves a quota just above the sum of all texts: no bucket ends it, and all are taken
    sure = placed.where("cut is null or bucket <> cut").withColumn("more", F.when(F.col("quota") < 0.5, 0).when(F.col("cut").isNull() | (F.col("bucket") < F.col("cut")), 1).otherwise(0))
    return sure.unionByName(last).select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("more")).alias("repeats")).where("repeats > 0")


def shares(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 0, vocabulary: str = VOCABULARY, of_all: bool = False) -> DataFrame:
    """Per listed source: target, available tokens, repetitions allowed and used, tokens in the mix, actual share and its deviation."""
    sizes = checkpointed(sized(documents, ["doc_id", "source"], vocabulary))  # texts are tokenised once
    plan = allotments(sizes, targets, _corpus_tokens(sizes) if of_all else total_tokens)
    got = _chosen(sizes, plan, seed).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats"))
    rows = [(s.source, s.target, s.available, s.max_repeats, s.epochs) for s in plan]
    listed = documents.sparkSession.createDataFrame(rows, "source string, target_share double, available_tokens bigint, max_repeats int, epochs double")
    n = F.coalesce("mixed_tokens", F.lit(0))
    actual = n / F.greatest(F.sum(n).over(Window.partitionBy()), F.lit(1))  # over one row per listed source
    return listed.join(got, "source", "left").select(
        "source", "target_share", "available_tokens", "max_repeats", "epochs", n.alias("mixed_tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), actual.alias("actual_share"), (actual - F.col("target_share")).alias("deviation")
    )
