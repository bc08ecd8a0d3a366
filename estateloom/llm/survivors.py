"""Best representative of each group of competing claims, field by field, with currency reasoning.

Claims rank by source precedence, confidence, time and order. Where times are missing among the claims that precedence and
confidence leave equal, currency is reasoned. From all timestamped rows the operator learns which value of an attribute
follows which, and how many more rows say so than say the reverse. These votes are closed transitively: the strength of a
chain of precedences is that of its weakest link, and one value is before another if the strongest chain that says so is
stronger than the strongest that says the reverse. This order is transitive and free of cycles whatever was learned
(beatpaths; Schulze 2011), so contradictions are settled by majority. Within a group the latest timed value and the untimed
values form a partial order, and the topologically latest ones stay: those that no other value of the group comes after.

A group may hold any share of the rows: survivors are chosen by map-side-combinable aggregates, never by a window over a
group; value transitions are found in windows over (group, day) and linked over two rows per such day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estateloom.functions.keys import attribute_key, entity_key, is_blank, says_something, strip
from estateloom.functions.skew import fitted_join, salted_join
from estateloom.session import discard, written

GROUP = ["assessment_id", "entity_type", "entity_key", "attribute"]

#: precedence of a claim whose document, or the document's precedence, is missing
DEFAULT_PRECEDENCE = 50


def keyed_claims(claims: DataFrame) -> DataFrame:
    """The claims under their compared keys. ``fact`` is a hash of what is said of which kind of attribute, null if nothing is."""
    keyed = claims.select(
        "assessment_id", "entity_type", entity_key("entity_type", "entity_key").alias("entity_key"), attribute_key("attribute").alias("attribute"),
        "claim_id", "ord", "value", "evidence_quote", "confidence", "source_document_id", "extracted_at",
    )
    return keyed.withColumn("fact", F.when(says_something("value"), F.xxhash64("entity_type", "attribute", F.lower(strip("value")))))


def learned_precedence(keyed: DataFrame) -> DataFrame:
    """(earlier, later, votes): pairs of facts of which the one follows the other ``votes`` times more than the reverse, over all timestamped rows.

    Groups and facts travel as 64-bit hashes; a chance collision adds one to a count. Successive rows are compared within a
    day of a group, then the last row of a day with the first of the group's next, one row per group and day.
    """
    timed = keyed.where("extracted_at is not null and fact is not null").select(F.xxhash64(*GROUP).alias("gid"), "fact", F.unix_micros("extracted_at").alias("at"), "ord")
    day = Window.partitionBy("gid", F.floor(F.col("at") / F.lit(86_400_000_000))).orderBy("at", "ord", "fact")
    rows = timed.select("gid", "at", "fact", F.lag("fact").over(day).alias("before"), F.lead("fact").over(day).alias("after"))
    # a day's first row waits for the last row of the day before; rows inside a day are not needed for that
    ends = rows.where("before is null or after is null").select("gid", "at", "fact", F.col("before").isNull().alias("opens"))
    across = ends.withColumn("before", F.lag("fact").over(Window.partitionBy("gid").orderBy("at", F.col("opens").desc()))).where("opens").select("before", "fact")
    steps = rows.select("before", "fact").where("before is not null").unionByName(across).where("before <> fact")
    pairs = steps.groupBy(F.least("before", "fact").alias("a"), F.greatest("before", "fact").alias("b")).agg(F.sum(F.when(F.col("before") < F.col("fact"), 1).otherwise(-1)).alias("way"))
    forward = F.col("way") > 0
    return pairs.where("way <> 0").select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("earlier"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("later"), F.abs("way").alias("votes"))


def beatpaths(learned: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, fact, votes): of every fact reachable from the facts of ``starts`` (fact) the strength of the strongest chain to it.

    Breadth first: a round carries on only chains that the round before made stronger, so it ends after as many rounds as the
    longest strongest chain has links. Chains are kept per starting fact, not per group; a round is one aggregate of what is
    known and what is reached, written to the shared folder in place of the round before.
    """
    links = written(learned)
    begun = links.join(starts.select(F.col("fact").alias("earlier")).distinct(), "earlier", "left_semi")
    state = written(begun.select(F.col("earlier").alias("start"), F.col("later").alias("fact"), "votes", F.lit(True).alias("grew")))
    while not state.where("grew").isEmpty():
        frontier = state.where("grew").select("start", F.col("fact").alias("earlier"), F.col("votes").alias("so_far"))
        onward = fitted_join(frontier, links, ["earlier"], ["start"], "inner").where("start <> later")
        reached = onward.select("start", F.col("later").alias("fact"), F.least("so_far", "votes").alias("votes"), F.lit(None).cast("bigint").alias("known"))
        both = state.select("start", "fact", "votes", F.col("votes").alias("known")).unionByName(reached)
        merged = both.groupBy("start", "fact").agg(F.max("votes").alias("votes"), F.max("known").alias("known"))
        before, state = state, written(merged.select("start", "fact", "votes", (F.coalesce("known", F.lit(0)) < F.col("votes")).alias("grew")))
        discard(before)
    return state.select("start", "fact", "votes")


def value_order(paths: DataFrame) -> DataFrame:
    """(fact, later, contradicted): pairs of which the chains one way are stronger than those the other way, if there are any."""
    back = paths.select(F.col("fact").alias("start"), F.col("start").alias("fact"), F.col("votes").alias("back"))
    both = paths.join(back, ["start", "fact"], "left").where("back is null or votes > back")
    return both.select(F.col("start").alias("fact"), F.col("fact").alias("later"), F.col("back").isNotNull().alias("contradicted"))


_RANK = ["precedence", "confidence"]


def _members(ranked: DataFrame, usable: str) -> DataFrame:
    """(gid, fact, timed) of groups in which an untimed claim is among those that rank first: its untimed facts and the latest timed one.

    Groups whose first claims all say one thing are left out, as nothing could overtake it: one aggregate finds the first rank
    with the least and the greatest fact said there, and only groups where these differ are read again.
    """
    flipped = F.bitwise_not("fact")  # the greatest of these belongs to the least fact
    firsts = ranked.where(usable).groupBy("gid").agg(F.max(F.struct(*_RANK, "fact")).alias("top"), F.max(F.struct(*_RANK, flipped.alias("fact")))["fact"].alias("low"), F.max(F.when(F.col("at").isNull(), F.struct(*_RANK))).alias("untimed"))
    open_ = firsts.where((F.struct(*(F.col(f"top.{r}") for r in _RANK)) == F.col("untimed")) & (F.col("top.fact") != F.bitwise_not("low")))
    tied = fitted_join(ranked.where(usable), written(open_.select("gid", "untimed.*")), ["gid", *_RANK], ["claim_id"], "inner")
    untimed = tied.where("at is null and fact is not null").select("gid", "fact").distinct().withColumn("timed", F.lit(False))
    latest = tied.where("at is not null").groupBy("gid").agg(F.max(F.struct("at", (-F.col("ord")).alias("order"), "claim_id", "fact"))["fact"].alias("fact")).where("fact is not null")
    return untimed.unionByName(latest.withColumn("timed", F.lit(True)))


def with_currency(ranked: DataFrame, keyed: DataFrame, usable: list[str]) -> DataFrame:
    """``currency_*`` of each claim for each kind of use: 0 if its value is overtaken by another of its group, else 1.

    An untimed claim is overtaken by a later value among the untimed ones and the latest timed one; timed claims are if their
    latest is. Where no time is missing nothing is reasoned, as times decide everything. Groups go by a 64-bit hash here.
    """
    if keyed.where("extracted_at is null").isEmpty():
        return ranked.select("*", *(F.lit(1).alias(f"currency_{u}") for u in usable))
    ranked = written(ranked.withColumn("gid", F.xxhash64("grp")))
    members = {u: written(_members(ranked, u)) for u in usable}
    starts = members[usable[0]].select("fact")
    for u in usable[1:]:
        starts = starts.union(members[u].select("fact"))
    starts = written(starts.distinct())
    ends = fitted_join(beatpaths(learned_precedence(keyed), starts), starts, ["fact"], ["start"], "inner")
    order = written(value_order(ends).select("fact", "later"))
    marked = ranked.withColumn("timed", F.col("at").isNotNull()).withColumn("said", F.when(F.col("at").isNotNull(), F.lit(0)).otherwise(F.col("fact")))
    for u in usable:
        after = fitted_join(members[u], order, ["fact"], ["gid"], "inner")
        overtaken = after.join(members[u].select("gid", F.col("fact").alias("later")).distinct(), ["gid", "later"], "left_semi")
        marks = written(overtaken.select("gid", "timed", F.when(F.col("timed"), F.lit(0)).otherwise(F.col("fact")).alias("said")).distinct().withColumn(f"currency_{u}", F.lit(0)))
        marked = fitted_join(marked, marks, ["gid", "timed", "said"], ["claim_id"], "left").withColumn(f"currency_{u}", F.coalesce(f"currency_{u}", F.lit(1)))
    return marked.drop("gid", "timed", "said")


def survivors(claims: DataFrame, documents: DataFrame, with_fields: bool = True) -> DataFrame:
    """One row per group of two or more distinct claims: the claims that give the value and the quote, and the built record.

    ``with_fields=False`` leaves the record's texts out, and they are not shuffled then.

    Edge cases: null keys group together; null confidence and NaN rank last; claims without a time go by currency, then
    behind timed ones; claims equal in every rank go by the higher ``claim_id``; redelivered rows
    count once; a document listed several times counts with its highest precedence; a group whose values all say nothing has
    '' as ``value_claim_id`` (likewise for quotes); an empty table gives an empty table; further columns are ignored.
    """
    documented = documents.groupBy(F.col("document_id").alias("source_document_id")).agg(F.max("precedence").alias("given"))
    confidence = F.when(F.isnan("confidence"), F.lit(None)).otherwise(F.col("confidence"))
    texts = ["value", "evidence_quote"] if with_fields else []
    keyed = keyed_claims(claims)
    flagged = keyed.select(
        F.struct(*GROUP).alias("grp"), "claim_id", "ord", "source_document_id", *texts, F.coalesce(confidence, F.lit(float("-inf"))).alias("confidence"),
        F.unix_micros("extracted_at").alias("at"), "fact", F.col("fact").isNotNull().alias("has_value"), (~is_blank("evidence_quote")).alias("has_quote"),
    )
    ranked = salted_join(flagged, documented, ["source_document_id"], ["claim_id"], "left").withColumn("precedence", F.coalesce("given", F.lit(DEFAULT_PRECEDENCE))).drop("given", "source_document_id")
    placed = with_currency(ranked, keyed, ["has_value", "has_quote"])

    def first(field: str, usable: str) -> Column:
        rank = [*_RANK, f"currency_{usable}", F.coalesce("at", F.lit(-(2**62))).alias("at"), (-F.coalesce("ord", F.lit(2**62))).alias("order"), "claim_id"]
        return F.max(F.when(F.col(usable), F.struct(*rank, *([field] if with_fields else []))))

    id_ = F.xxhash64("claim_id")
    groups = placed.groupBy(*(F.col("grp")[g].alias(g) for g in GROUP)).agg(F.min(id_).alias("a"), F.max(id_).alias("b"), first("value", "has_value").alias("v"), first("evidence_quote", "has_quote").alias("q"))
    record = [strip("v.value").alias("value"), F.col("q.evidence_quote").alias("evidence_quote")] if with_fields else []
    return groups.where("a <> b").select(*GROUP, F.coalesce("v.claim_id", F.lit("")).alias("value_claim_id"), F.coalesce("q.claim_id", F.lit("")).alias("quote_claim_id"), *record)


def untimed(claims: DataFrame) -> DataFrame:
    """The claims with every third time missing, by ``ord``."""
    return claims.withColumn("extracted_at", F.when(F.col("ord") % 3 != 0, F.col("extracted_at")))
