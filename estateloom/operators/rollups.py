"""Roll-ups, review counts, fingerprints and decision logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estateloom.functions.keys import is_blank


def usage_rollup(events: DataFrame) -> DataFrame:
    """Calls, value and errors by day, by kind of event, and in total, in one pass over grouping sets."""
    rows = events.select(F.date_format("ts", "yyyy-MM-dd").alias("run"), F.col("event_type").alias("stage"), F.col("value").cast("decimal(18,2)").alias("value"))
    return rows.groupingSets([["run"], ["stage"], []], "run", "stage").agg(
        F.count("*").alias("calls"), F.sum("value").cast("double").alias("total"), F.bool_or(F.col("stage") == "error").alias("has_error")
    )


def usage_counters(events: DataFrame) -> DataFrame:
    keys = [F.date_format("ts", "yyyy-MM").alias("run"), F.col("event_type").alias("stage"), "user_id", F.get_json_object("props", "$.k").cast("int").alias("k")]
    return events.groupBy(*keys).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("total"))


def report_metrics(claims: DataFrame) -> DataFrame:
    """Per assessment: claims, share of cited ones in percent, entities, and counts of what needs review."""
    c = claims.dropDuplicates(["claim_id"])
    cited = (F.size("evidence_refs") > 0) & ~is_blank("evidence_quote")
    return c.groupBy("assessment_id").agg(
        F.count("*").alias("n_claims"), F.count_if(cited).alias("n_cited"), F.round(F.count_if(cited) * 100.0 / F.count("*"), 1).alias("cited_pct"), F.count_if(F.col("unsupported")).alias("n_unsupported"),
        F.countDistinct(F.lower(F.concat_ws("|", "entity_type", F.trim("entity_key")))).alias("n_entities"),
    )


def review_queue(claims: DataFrame) -> DataFrame:
    """Per assessment: open and closed reviews, overrides, and whether the queue is clear."""
    c = claims.dropDuplicates(["claim_id"])
    open_ = F.col("needs_human_review") & (F.col("review_status") == "pending")
    return c.groupBy("assessment_id").agg(
        F.count_if(open_).alias("n_open"), F.count_if(F.col("review_status").isin("accepted", "overridden")).alias("n_settled"), F.count_if(F.col("review_status") == "rejected").alias("n_rejected"),
        F.count_if(~is_blank("override_value")).alias("n_overrides"), (F.count_if(open_) == 0).alias("clear"),
    )


def state_fingerprint(claims: DataFrame) -> DataFrame:
    """Per assessment: count and latest change of its claims, joined to one text that changes whenever they do."""
    return claims.groupBy("assessment_id").agg(F.concat_ws("|", F.count("*").cast("string"), F.max("ord").cast("string"), F.date_format(F.max("ingested_at"), "yyyy-MM-dd HH:mm:ss")).alias("fingerprint"))


def missing_attributes(claims: DataFrame) -> DataFrame:
    """(assessment, entity type, attribute) that the type has somewhere but not in this assessment: a difference of sets."""
    have = claims.select("assessment_id", "entity_type", F.translate(F.lower("attribute"), " -", "__").alias("attribute")).distinct()
    universe = have.select("entity_type", "attribute").distinct()
    pairs = have.select("assessment_id", "entity_type").distinct().join(universe, "entity_type")  # attributes of a type are few
    return pairs.join(have, ["assessment_id", "entity_type", "attribute"], "left_anti").select("assessment_id", "entity_type", "attribute")


def latest_decisions(events: DataFrame) -> DataFrame:
    """The latest entry of an append-only log per (user, kind): an upsert on read."""
    return events.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("last"), F.count("*").alias("n_entries")).select(
        "user_id", "event_type", "last.event_id", "last.value", "n_entries"
    )


def ordered_distinct(claims: DataFrame) -> DataFrame:
    """Distinct values of each attribute in the order of first appearance."""
    a = F.translate(F.lower("attribute"), " -", "__").alias("attribute")
    return claims.where("value is not null").groupBy(a, F.trim("value").alias("value")).agg(F.min("ord").alias("first_ord"), F.countDistinct("claim_id").alias("n"))


def sessions(events: DataFrame, gap_seconds: int = 7200) -> DataFrame:
    """Sessions of each user, closed after ``gap_seconds`` without an event: (user_id, started, ended, n_events, total).

    Events of one slot of the clock as long as the gap always share a session, so they are summed up first, map-side; only
    these slots, of which a user has no more than the time spanned holds, are ordered. Rows without a time are left out.
    """
    gap = gap_seconds * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    slots = events.where("ts is not null").groupBy("user_id", F.floor(at / F.lit(gap)).alias("slot")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("n"), F.sum("value").alias("total")
    )
    by_user = Window.partitionBy("user_id").orderBy("slot")
    opens = F.when(F.col("a") - F.lag("b").over(by_user) < gap, 0).otherwise(1)
    numbered = slots.withColumn("opens", opens).withColumn("session", F.sum("opens").over(by_user))
    return numbered.groupBy("user_id", "session").agg(F.min("first").alias("started"), F.max("last").alias("last"), F.sum("n").alias("n_events"), F.round(F.sum("total"), 2).alias("total")).select(
        "user_id", "started", (F.col("last") + F.make_dt_interval(secs=F.lit(gap_seconds))).alias("ended"), "n_events", "total"
    )


def neighbours_in_time(events: DataFrame) -> DataFrame:
    """As-of: each purchase with the user's last view before it, however old.

    Views of the purchase's own day come from a running last view within (user, day). Views are also reduced to the last one
    of each day, and these are carried forward over a user's days for purchases without an earlier view on their day, so no
    group holds more than a user's events of one day, or one row per day of a user.
    """
    day, view = F.to_date("ts").alias("day"), F.when(F.col("event_type") == "view", F.struct(F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"))).alias("view")
    rows = events.where("event_type in ('view', 'purchase') and user_id is not null and ts is not null").select("user_id", day, "ts", "event_id", view)
    # at the same time purchases come first: a view counts only for later ones
    so_far = Window.partitionBy("user_id", "day").orderBy("ts", F.col("view").isNotNull(), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    buys = rows.withColumn("same_day", F.last("view", ignorenulls=True).over(so_far)).where("view is null").drop("view")
    earlier = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy("user_id", "day").agg(F.max("view").alias("view")).select("user_id", "day", F.last("view", ignorenulls=True).over(earlier).alias("carried"))
    last = buys.join(days, ["user_id", "day"]).withColumn("last", F.coalesce("same_day", "carried")).where("last is not null")
    return last.groupBy("user_id", "event_id").agg(F.max("last").alias("last")).select("user_id", "event_id", "last.view_id")


def attribute_answers(claims: DataFrame) -> DataFrame:
    """Per assessment and attribute the facts as one answer: mean confidence, whether all are supported and any needs review, references, the value said most."""
    c = claims.dropDuplicates(["claim_id"]).where(~is_blank("value")).withColumn("attribute", F.translate(F.lower("attribute"), " -", "__")).withColumn("said", F.lower(F.trim("value")))
    conf = F.coalesce(F.nanvl("confidence", F.lit(None).cast("double")), F.lit(0.0))
    values = c.groupBy("assessment_id", "attribute", "said").agg(
        F.count("*").alias("n"), F.sum(conf.cast("decimal(18,6)")).alias("conf"), F.bool_and(~F.col("unsupported")).alias("supported"), F.bool_or("needs_human_review").alias("review"), F.sum(F.size("evidence_refs")).alias("refs")
    )
    return values.groupBy("assessment_id", "attribute").agg(
        F.sum("n").alias("n_claims"), F.round(F.sum("conf").cast("double") / F.sum("n"), 6).alias("confidence"), F.bool_and("supported").alias("supported"), F.bool_or("review").alias("review"), F.sum("refs").alias("n_refs"),
        F.max_by("said", F.struct("n", "said")).alias("most_said"),
    )
