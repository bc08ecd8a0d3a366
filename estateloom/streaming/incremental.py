"""Streams: windowed counts, summed over batches or under a watermark, and claims kept at their latest state, through idempotent batch writes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estateloom.session import shared_folder


def hourly(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """(started, event_type, n, total) of event-time windows."""
    counted = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("started"), "event_type", "n", "total")


def windowed_counts(stream: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(started, event_type, n, total) of event-time windows for a live stream that must close its windows.

    Events later than the watermark are dropped from the state; where all events count, use ``accumulated``.
    """
    return hourly(stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), window)


def _run(stream: DataFrame, folder: str, prepare: Callable[[DataFrame], DataFrame] | None) -> None:
    """Writes each batch of ``stream`` under its number, so a batch that is run again replaces itself; the checkpoint lies
    beside the data, so a later run goes on where this one stopped."""

    def write(batch: DataFrame, number: int) -> None:
        (prepare(batch) if prepare else batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/data/batch={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def accumulated(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], keys: list[str], folder: str) -> DataFrame:
    """Sums over everything that ``stream`` ever delivered, by ``keys``: each batch is aggregated by ``partial`` to its own sums
    (numeric columns beside the keys), and the sums of all batches are added up on read.

    No watermark is needed, so the result does not depend on how rows fall into batches or on their order; the state holds
    one row per key and batch.
    """
    _run(stream, folder, partial)
    spark = stream.sparkSession
    schema = partial(spark.createDataFrame([], stream.schema)).schema
    rows = spark.read.schema(schema).option("basePath", f"{folder}/data").parquet(f"{folder}/data/batch=*")
    sums = [f for f in schema if f.name not in keys]
    return rows.groupBy(*keys).agg(*((F.round(F.sum(f.name), 2) if f.dataType.simpleString() == "double" else F.sum(f.name)).alias(f.name) for f in sums))


def upserted(stream: DataFrame, keys: list[str], folder: str, order: str | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs ``stream`` over everything available and gives the latest row of each key.

    The latest state is an aggregate on read, by batch and by ``order`` within a batch.
    """
    _run(stream, folder, prepare)
    rows = stream.sparkSession.read.schema(stream.schema).option("basePath", f"{folder}/data").parquet(f"{folder}/data/batch=*").withColumn("__batch", F.regexp_extract(F.input_file_name(), r"batch=(\d+)", 1).cast("bigint"))
    others = [c for c in stream.columns if c not in keys]
    last = F.max_by(F.struct(*others), F.struct("__batch", *([order] if order else [])))
    return rows.groupBy(*keys).agg(last.alias("last")).select(*keys, *(F.col(f"last.{c}").alias(c) for c in others))


def parquet_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1000) -> DataFrame:
    """A table folder as a stream; its schema is read once from its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{name}.parquet*")


def event_windows(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1000) -> DataFrame:
    """Hourly windows of the events table, run as a stream in the shared folder; no event is late, whatever batch it comes in."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"
    return accumulated(parquet_stream(spark, sf_dir, "events", files_per_trigger), hourly, ["started", "event_type"], folder)


def latest_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redelivered claims at their first delivery: an incremental deduplication by key, whatever batch a delivery comes in."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"
    stream = parquet_stream(spark, sf_dir, "claims").select("claim_id", "ord", "attribute", "value", "ingested_at")
    first = lambda b: b.groupBy("claim_id").agg(F.min_by(F.struct("ord", "attribute", "value", "ingested_at"), "ingested_at").alias("r")).select("claim_id", "r.*")
    _run(stream, folder, first)
    return first(spark.read.schema(stream.schema).parquet(f"{folder}/data/batch=*")).select("claim_id", "ord", "attribute", "value")
